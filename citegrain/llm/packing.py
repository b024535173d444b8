"""Packing documents into sequences of at most CAPACITY tokens by cutting-stock column generation.

Documents are tokenized once into a table of ids. A document longer than a sequence is cut into whole
sequences and a rest. The lengths of all pieces, rounded up to units, form a histogram of at most
CAPACITY / UNIT sizes, which is all that reaches the driver. There a linear program over patterns
of sizes, with patterns priced by a knapsack dynamic program, says how many sequences of each
pattern to fill; the amounts are rounded to whole numbers. Pieces of one size are ranked, and the
ranks are dealt out to the patterns: a piece's rank gives its sequence. Pieces that rounding leaves
over (at most a sequence's worth for each size, whatever the corpus holds) are laid end to end and
cut at the ends of sequences; the last of these sequences is cut into powers of two, which need
no padding.

Ranks are counted per size and hashed bucket and then added up, so a size that a third of all
pieces have isn't sorted in one task. A piece never shares a task with more than its bucket or
its sequence.

Nulls and odd input: a null text is empty, and an empty one still has the end token. Repeated rows are
packed once each; ids may repeat or be null. Other columns don't matter. An empty table gives an
empty result. A very long text is tokenized in
pieces of bounded size; its ids are one row. Any tokenizer file may be given (see tokens).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.llm.common import table, written
from citegrain.llm.cutting_stock import whole_patterns
from citegrain.llm.tokens import Memo, Tokens

CAPACITY, UNIT = 4096, 16
#: Rows of pieces in a bucket for ranking, about; texts that are tokenized at once.
BUCKET_ROWS, TEXTS = 50_000, 500


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, ids, crcs): ids as little-endian 32-bit numbers, and the CRC-32 of each run
    of CAPACITY ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, memo = Tokens.of(tokenizer), Memo()
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                ids = tokens([t or "" for t in batch.column("text").to_pylist()], memo)
                crcs = [[zlib.crc32(memoryview(x)[k : k + 4 * CAPACITY]) for k in range(0, len(x), 4 * CAPACITY)] for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(crcs, pa.list_(pa.int64()))], ["row", "doc_id", "n", "ids", "crcs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, "row bigint, doc_id bigint, n bigint, ids binary, crcs array<bigint>"), "tokens", "snappy")


def _dealt(sizes: np.ndarray, patterns: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, pieces of it in a sequence, first sequence) of what each size
    gives to each pattern."""
    first = np.concatenate(([0], np.cumsum(counts)))
    rank, out = np.zeros(len(sizes), np.int64), []
    for p, k in zip(*np.nonzero(patterns), strict=True):
        n = patterns[p, k] * counts[p]
        out.append((int(sizes[k]), int(rank[k]), int(rank[k] + n), int(patterns[p, k]), int(first[p])))
        rank[k] += n
    return out


def _ranked(pieces: DataFrame, n: int) -> DataFrame:
    """pieces with rank, from 0, among those of their size."""
    buckets = max(64, n // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)))
    counts = pieces.groupBy("size", "bucket").agg(F.count("*").alias("m"))
    before = counts.select("size", "bucket", (F.sum("m").over(Window.partitionBy("size").orderBy("bucket")) - F.col("m")).alias("before"))
    place = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("row", "start")) - 1
    return pieces.withColumn("place", place).join(before, ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "place", "before")


def packed(tokens: DataFrame, unit: int = UNIT) -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece."""
    spark = tokens.sparkSession
    start = (F.col("at") * CAPACITY).cast("long")
    pieces = tokens.select("row", "doc_id", F.col("n").alias("doc_tokens"), F.posexplode("crcs").alias("at", "ids_crc32"))
    pieces = pieces.select("row", "doc_id", start.alias("start"), F.least(F.lit(CAPACITY), F.col("doc_tokens") - start).cast("long").alias("length"), "ids_crc32", "doc_tokens")
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    histogram = sorted((r["size"], r["count"]) for r in pieces.groupBy("size").count().collect())  # CAPACITY / unit rows at most
    sizes, demands = np.array(histogram, np.int64).reshape(-1, 2).T
    patterns, counts, _ = whole_patterns(sizes, demands, CAPACITY // unit)

    deals = _dealt(sizes, patterns, counts) or [(0, 0, 0, 1, 0)]
    names = ("d_size", "d_from", "d_to", "d_each", "d_first")
    dealt = spark.createDataFrame(deals, "d_size int, d_from long, d_to long, d_each long, d_first long").select(*names)
    ranked = _ranked(pieces, int(demands.sum()))
    # bounded by the sizes and the patterns: CAPACITY / unit of each and a few more
    ranked = ranked.join(F.broadcast(dealt), (F.col("size") == F.col("d_size")) & (F.col("rank") >= F.col("d_from")) & (F.col("rank") < F.col("d_to")), "left")
    ranked = ranked.withColumn("sequence_id", F.expr("d_first + (rank - d_from) div d_each")).drop("size", "rank", *names)
    ranked = written(ranked, "pieces")

    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start")
    full = ranked.where("sequence_id IS NOT NULL").withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return full.unionByName(_leftover(ranked.where("sequence_id IS NULL"), tokens, int(counts.sum())))


def _leftover(pieces: DataFrame, tokens: DataFrame, first: int) -> DataFrame:
    """Pieces laid end to end and cut where sequences end; sequences are numbered from first. There
    are at most CAPACITY / unit sequences' worth, so one task can lay them out."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    ends = list(range(0, total + 1, CAPACITY))
    for bit in range(CAPACITY.bit_length() - 2, -1, -1):
        if (total % CAPACITY) >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    bounds = F.array(*map(F.lit, ends)).cast("array<bigint>")
    to = F.sum("length").over(Window.orderBy("row", "start").rowsBetween(Window.unboundedPreceding, 0))
    laid = pieces.withColumn("to", to).withColumn("from", F.col("to") - F.col("length"))
    inner: Column = F.filter(bounds, lambda b: (b > F.col("from")) & (b < F.col("to")))
    cut = laid.select("row", "doc_id", "doc_tokens", (F.col("start") - F.col("from")).alias("shift"), F.explode(F.arrays_zip(F.concat(F.array("from"), inner).alias("a"), F.concat(inner, F.array("to")).alias("b"))).alias("x"))
    before = F.filter(bounds, lambda b: b <= F.col("x.a"))
    cut = cut.select("row", "doc_id", "doc_tokens", (F.col("x.a") + F.col("shift")).alias("start"), (F.col("x.b") - F.col("x.a")).alias("length"), (F.size(before) - 1 + first).cast("long").alias("sequence_id"), (F.col("x.a") - F.array_max(before)).alias("offset"))
    crc = F.crc32(F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    return tokens.select("row", "ids").join(F.broadcast(cut), "row").select("row", "doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, unpadded, as little-endian 32-bit numbers."""
    part = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    parts = pieces.join(tokens.select("row", "ids"), "row").select("sequence_id", F.struct("offset", F.hex(part).alias("ids")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"]), "")
    return parts.groupBy("sequence_id").agg(F.unhex(whole).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed(tokenized(docs, default_tokenizer())).drop("row")
