"""Sharding by a two-pass external shuffle.

First pass: a seeded hash of each row's place in the input scatters rows uniformly into buckets
that fit in memory; neither a hot key nor equal rows fall together. Second pass: each bucket is put
in a defined order, shuffled by Fisher and Yates's method with a generator seeded by the bucket,
and written. The buckets one after another are the shuffled table: a row's rank in it is the rows
of all buckets before plus its place in its own, and shard s of S holds the ranks from s*N/S, so
counts are at most one apart (law `rows`).

A task shuffles one bucket after another; there are as many tasks as buckets, MOST_TASKS at most.

Nulls and odd input: a null text counts as empty for size; rows pass through as they are, with all
their columns, but columns named __shard and __slot are replaced; repeated rows each get a place. A row larger than a bucket has a bucket's memory and
its own. An empty table gives an empty result. What the shards hold depends on the seed and on how
the input is split in files, not on which executor does what: a lost task is redone alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.llm.common import free_names, table, written

SHARDS, SEED = 8, 20
#: Bytes of text in a bucket, about; and buckets at least, for parallelism.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64
#: Rows of bucket counts up to which they are sent to all executors; tasks that shuffle buckets, at most.
BROADCAST_ROWS, MOST_TASKS = 1_000_000, 100_000


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n)."""
    picks = np.random.default_rng(seed).integers(0, np.arange(1, n + 1)).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled(df: DataFrame, n_bytes: int, names: tuple[str, str] = ("__bucket", "__place"), seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS) -> tuple[DataFrame, int]:
    """df written in shuffled order, with columns of these names for the bucket and the place in it; and
    the number of buckets."""
    buckets = max(least_buckets, math.ceil(n_bytes / bucket_bytes))
    own, place = names
    (row,) = free_names(df, "__row")
    rows = df.withColumn(row, F.monotonically_increasing_id())
    rows = rows.withColumn(own, F.pmod(F.xxhash64(F.lit(seed), row), F.lit(buckets)).cast("int"))

    def shuffle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.take(pc.sort_indices(bucket[row]))
        n = bucket.num_rows
        bucket = bucket.take(fisher_yates(n, seed * 1_000_003 + bucket[own][0].as_py()))
        return bucket.drop_columns([row]).append_column(place, pa.array(np.arange(n)))

    schema = T.StructType([*df.schema.fields, T.StructField(own, T.IntegerType()), T.StructField(place, T.LongType())])
    # dealt by bucket already, so that grouping adds no shuffle and isn't bound to the session's partitions
    return written(rows.repartition(min(buckets, MOST_TASKS), own).groupBy(own).applyInArrow(shuffle, schema), "shuffled"), buckets


def sharded(df: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with `__shard` and `__slot`, shuffled."""
    df = df.drop("__shard", "__slot")
    n_bytes = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64)).first()[0] or 0
    own, place, start, every, rank = free_names(df, "__bucket", "__place", "__start", "__all", "__rank")
    rows, buckets = shuffled(df, n_bytes, (own, place), seed, bucket_bytes)
    counts = rows.groupBy(own).agg(F.count("*").alias("n"))
    starts = counts.select(own, (F.sum("n").over(Window.orderBy(own)) - F.col("n")).alias(start), F.sum("n").over(Window.partitionBy()).alias(every))
    starts = F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts
    ranked = rows.join(starts, own).withColumn(rank, F.col(start) + F.col(place))
    ranked = ranked.withColumn("__shard", F.expr(f"({rank} * {shards}L) div {every}"))
    first = F.expr(f"((__shard * {every}) + {shards - 1}L) div {shards}L")
    return ranked.select(*df.columns, F.col("__shard").cast("int").alias("__shard"), (F.col(rank) - first).alias("__slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """A folder for each shard, in it its rows in the order of their slots."""
    df.repartition("__shard", F.floor(F.col("__slot") / 100_000)).sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
