"""Language ID with bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its commonest n-grams (n = 2, 3, 4; by number of documents of
that language that hold them). The filters are bit-sliced: a slot is a mask with one bit for each
language, so one look-up ANDs a few slots and returns all languages that (seem to) contain an n-gram.
A text's n-grams are looked up one by one; bits are counted per language. A filter of which a share
f of slots is set answers yes by chance at the rate fp = f**k, so of n look-ups with c hits about
(c - n*fp) / (1 - fp) are true. The language with most true hits wins, ties by name; the score is its
share of true hits.

Texts are lower-cased; runs of anything but letters are one boundary mark, which n-grams may hold.
A text that is null or has no letter is `und` with score 0. Only text and lang of the training rows
teach; a prediction sees the text alone. The filters are fitted on a sample: about `per_language`
documents of each language, drawn by a hash of the id; fewer if there are fewer. Everything else,
the prediction of whole texts and the count of training rows, covers all rows.

Nulls and odd input: rows with a null lang or id don't teach. Without training rows every text is
`und`. Repeated rows get equal predictions; other columns don't matter; empty tables give empty
results. A very long text is read in pieces of PIECE characters; only its lower-case copy is whole.
More than `most_languages` distinct values of lang are an error, as the filters of so many (8 kB each)
would not be small; no language is ever left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.llm.common import mixed, received, sent, table

UNKNOWN = "und"
#: Sampled documents and n-grams of each language; slots of the filters (a power of two); hashes.
PER_LANGUAGE, NGRAMS, SLOT_BITS, HASHES, ORDERS = 1500, 4000, 16, 2, (2, 3, 4)
#: Code points of text that are handled at once.
PIECE = 1 << 19
MOST_LANGUAGES = 4096


class Letters:
    """Turns text into code points in which runs of anything but letters are one 0."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, np.int8)  # 0: not looked up yet; 1: a letter; -1: none

    def _letters(self, points: np.ndarray) -> np.ndarray:
        kinds = self.known[points]
        if not kinds.all():
            for c in np.unique(points[kinds == 0]).tolist():
                self.known[c] = 1 if unicodedata.category(chr(c))[0] == "L" else -1
            kinds = self.known[points]
        return kinds > 0

    def pieces(self, text: str) -> Iterator[tuple[np.ndarray, int]]:
        """(code points, number of them at which n-grams begin) of the text between two boundaries. A piece
        ends in the points that the next one starts with, so each n-gram begins in one piece."""
        text, carry, after, more = text.lower(), np.zeros(1, np.uint64), False, max(ORDERS) - 1
        for begin in range(0, max(1, len(text)), PIECE):
            points = np.frombuffer(text[begin : begin + PIECE].encode("utf-32-le", "replace"), np.uint32)
            letter = self._letters(points)
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            if len(keep):
                keep[0] |= after
                after = bool(letter[-1])
            own = np.where(letter, points, 0)[keep].astype(np.uint64)
            if begin + PIECE >= len(text):
                whole = np.concatenate((carry, own, np.zeros(1, np.uint64)))
                yield whole, len(whole)
            else:
                whole = np.concatenate((carry, own))
                cut = max(0, len(whole) - more)
                yield whole, cut
                carry = whole[cut:]


def ngrams(points: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams of this order, in place."""
    if len(points) < order:
        return np.zeros(0, np.uint64)
    n = len(points) - order + 1
    h = np.full(n, order, np.uint64)
    for i in range(order):
        h = h * np.uint64(0x100000001B3) + points[i : i + n]
    return mixed(h)


class Filters:
    """Bit-sliced Bloom filters: a mask of languages in each slot."""

    def __init__(self, languages: list[str], bits: int = SLOT_BITS, hashes: int = HASHES) -> None:
        self.languages, self.bits, self.hashes = languages, bits, hashes
        self.slots = np.zeros(((len(languages) + 63) // 64, 1 << bits), np.uint64)

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Slots of each n-gram, from separate bits of its hash."""
        return [((hashes >> np.uint64(64 - (i + 1) * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for i in range(self.hashes)]

    def add(self, language: int, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            self.slots[language // 64][at] |= np.uint64(1 << language % 64)

    def false_rates(self) -> np.ndarray:
        return np.array([((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** self.hashes for i in range(len(self.languages))])

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """(words of 64 languages, n-grams)"""
        return reduce(np.bitwise_and, (self.slots[:, at] for at in self.places(hashes)))


def training(docs: DataFrame) -> Column:
    """True where a row may teach: it has a language and its id's CRC-32 modulo 4 is not 2."""
    return F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, top: int = NGRAMS, most_languages: int = MOST_LANGUAGES) -> Filters:
    """Filters from rows of doc_id, text and lang, all of which teach; a ValueError beyond most_languages."""
    counts = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = sorted((r["lang"], r["count"]) for r in counts)
    filters = Filters([lang for lang, _ in counts])
    if not counts:
        return filters
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, per_language / n))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1_000_003)) < F.try_element_at(share, F.col("lang")) * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, found = Letters(), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.zeros(0, np.uint64)
                for points, begun in letters.pieces(text or ""):
                    own = np.unique(np.concatenate([own, *(ngrams(points, n)[:begun] for n in ORDERS)]))
                for h in own.tolist():
                    found[lang, h] = found.get((lang, h), 0) + 1
            # what has been counted goes on now and then, so this holds a bounded number of n-grams
            if len(found) > 1_000_000:
                yield rows_of(found)
                found = {}
        yield rows_of(found)

    def rows_of(found: dict) -> pa.RecordBatch:
        langs, hashes = zip(*found, strict=True) if found else ((), ())
        return pa.record_batch({"lang": pa.array(langs, pa.string()), "h": pa.array(np.array(hashes, np.uint64).view(np.int64)), "n": pa.array(list(found.values()), pa.int64())})

    grams = sample.select("lang", "text").mapInArrow(count, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "h")
    best = grams.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).groupBy("lang").agg(F.collect_list("h").alias("hs"))
    for row in best.collect():
        filters.add(filters.languages.index(row["lang"]), np.array(row["hs"], np.int64).view(np.uint64))
    return filters


def classifier(filters: Filters) -> Callable[[list[str]], tuple[list[str], list[float]]]:
    rates, letters = filters.false_rates(), Letters()
    n_lang = len(filters.languages)

    def count(points: np.ndarray, ends: np.ndarray, begun: np.ndarray, out: np.ndarray, totals: np.ndarray) -> None:
        """Adds the hits per language and the look-ups of the pieces that end at ends, of the n-grams that
        begin in the first `begun` points of each."""
        owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
        starts = np.concatenate(([0], ends[:-1]))
        for n in ORDERS:
            hashes = ngrams(points, n)
            if not len(hashes):
                continue
            whole = owner[: len(hashes)] == owner[n - 1 :]
            masks = filters.masks(hashes)
            lo, hi = np.minimum(starts, len(hashes)), np.minimum(starts + begun, len(hashes))
            for i in range(n_lang + 1):
                bit = whole if i == n_lang else ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool) & whole
                sums = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
                (totals if i == n_lang else out[:, i])[:] += sums[hi] - sums[lo]

    def classify(texts: list[str]) -> tuple[list[str], list[float]]:
        hits, totals = np.zeros((len(texts), max(1, n_lang)), np.int64), np.zeros(len(texts), np.int64)
        has, held, size = np.zeros(len(texts), bool), [], 0

        def flush(held: list[tuple[int, np.ndarray, int]]) -> None:
            if held:
                rows, pieces, begun = zip(*held, strict=True)
                own_hits, own_totals = np.zeros((len(rows), max(1, n_lang)), np.int64), np.zeros(len(rows), np.int64)
                count(np.concatenate(pieces), np.cumsum([len(p) for p in pieces]), np.array(begun), own_hits, own_totals)
                np.add.at(hits, list(rows), own_hits)
                np.add.at(totals, list(rows), own_totals)

        for row, text in enumerate(texts):
            for points, begun in letters.pieces(text):
                has[row] |= points.any()
                held.append((row, points, begun))
                size += len(points)
                if size >= PIECE:
                    flush(held)
                    held, size = [], 0
        flush(held)
        if not n_lang:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        true = np.clip((hits - totals[:, None] * rates) / (1 - rates), 0, None)
        best = true.argmax(axis=1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(totals, 1), 0, 1)
        return [filters.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0).tolist()

    return classify


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    # the filters' size is bounded by the number of languages and SLOT_BITS, not by the rows
    known = sent(docs.sparkSession, filters)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(received(known))
        for batch in batches:
            langs, scores = classify([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(training(docs)).select("doc_id", "text", "lang"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
