"""Substring dedup by seed and extend: remove what any `LENGTH` consecutive words repeat.

Seeds. Every window of `length` words picks one of its k-grams, the one with the smallest hash
(the last of equals). The choice depends on the window's words alone, so two equal windows pick the
same k-gram at the same place: joining positions on the picked k-grams (anchors) finds every repeat.
All windows that pick one anchor position start in one short run [low, high].

Extension. An anchor position's context is all words that its windows cover. Positions that share an
anchor are first compared by whole context: if a context is there twice, so are all its windows. Where
an anchor is shared but a context is not, the match is extended word by word: every window of the run,
that is each reach to the left with the rest to the right, is a candidate, and those that are found
at two positions or more are repeats. Runs of repeated windows are then merged into maximal
repeats, which are removed. Equal contexts stand for one another in the extension, so a passage
that a third of the documents share is a row a task, not all pairs of its holders.

Windows are compared by 128 bits of hash. Each distinct text is searched once, with the number of its
copies; a text that is there twice repeats all its windows. Counts are combined before they are
shuffled, and rows of hot keys (a passage that very many texts hold) aren't shuffled at all. Runs are
gathered per distinct text, so a list is bounded by that text, and what is cut is worked out per
distinct text and joined to the rows that hold it.

Nulls and odd input: a null text has no words; a text of fewer words than a window keeps them all.
Rows with equal texts are different documents: their windows repeat each other. Repeated windows
inside one text count. Columns other than the text pass through, whatever their names; those named
__n_words, __n_removed and __kept are replaced. An empty table gives an empty result. Very long texts
are taken alone, and their arrays are proportional to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm.common import Powers, WordKernel, chunks, distinct_texts, free_names, hot_join, table, text_key, written

LENGTH, SEED_WORDS = 35, 8


class Windows:
    """Hashes, anchors and contexts of the windows of a run of texts."""

    def __init__(self, length: int = LENGTH, seed: int = SEED_WORDS) -> None:
        self.length, self.seed = length, seed
        self.kernel, self.one, self.two = WordKernel(), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)

    def load(self, data: bytes, offsets: np.ndarray) -> None:
        raw = np.frombuffer(data, np.uint8)
        self.starts, self.ends = self.kernel.bounds(raw)
        words = self.kernel.hashes(raw, self.starts, self.ends)
        self.sum1, self.sum2 = self.one.sums(words), self.two.sums(words)
        #: the first word of each text, and the number of words at the end
        self.first = np.searchsorted(self.starts, offsets)
        self.n = len(words)

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.one.ranges(self.sum1, starts, ends).view(np.int64), self.two.ranges(self.sum2, starts, ends).view(np.int64)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """row, place, low, high (of window starts) and hash of each anchor position."""
        empty = (np.zeros(0, np.int64),) * 5
        if self.n < self.length:
            return empty
        grams = self.one.ranges(self.sum1, np.arange(self.n - self.seed + 1), np.arange(self.seed, self.n + 1))
        width = self.length - self.seed + 1
        # windows at all places; those that go over the end of a text are left out
        counts = np.maximum(0, np.diff(self.first) - self.length + 1)
        row = np.repeat(np.arange(len(counts)), counts)
        if not len(row):
            return empty
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[row]
        view = sliding_window_view(grams, width)[:, ::-1]
        picked = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            picked[i : i + (1 << 16)] = at[i : i + (1 << 16)] + width - 1 - view[at[i : i + (1 << 16)]].argmin(axis=1)
        new = np.flatnonzero(np.concatenate(([True], (picked[1:] != picked[:-1]) | (row[1:] != row[:-1]))))
        last = np.concatenate((new[1:], [len(at)])) - 1
        return row[new], picked[new], at[new], at[last], grams[picked[new]].view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = Windows()
    for batch in batches:
        k1, k2, copies = (batch.column(c).to_numpy() for c in ("k1", "k2", "copies"))
        for begin, _, data, offsets in chunks(batch.column("text")):
            w.load(data, offsets)
            row, place, low, high, anchor = w.anchors()
            c1, _ = w.hashed(low, high + w.length)
            # the context's hash also says where in it the anchor is
            c1 = c1 ^ ((place - low) << 8 | (high - low))
            base = w.first[row]
            yield pa.record_batch({"k1": k1[row + begin], "k2": k2[row + begin], "copies": copies[row + begin], "anchor": anchor, "context": c1, "low": (low - base).astype(np.int32), "high": (high - base).astype(np.int32)})


def repeated_starts(texts: DataFrame) -> DataFrame:
    """(k1, k2, runs) from distinct texts (k1, k2, copies, text): for each with repeats, runs [low, high] of
    starts of windows whose words start elsewhere too."""
    places = texts.mapInArrow(_anchors, "k1 bigint, k2 bigint, copies bigint, anchor bigint, context bigint, low int, high int")
    shared = places.groupBy("anchor").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 1").select("anchor", "rows")
    near = written(hot_join(places, written(shared, "shared"), ["anchor"], "rows"), "seeds")

    # a context that is there twice repeats all its windows; one position stands for all of a context
    first = F.min(F.struct("k1", "k2", "low", "high")).alias("first")
    classes = written(near.groupBy("anchor", "context").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"), first), "contexts")
    whole = hot_join(near, classes.where("n > 1").select("anchor", "context", "rows"), ["anchor", "context"], "rows").select("k1", "k2", "low", "high")

    # contexts that share their anchor with another context are opened
    opened = classes.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    asked = hot_join(classes.drop("rows"), written(opened, "opened"), ["anchor"], "contexts").select("first.*", (F.col("n") > 1).alias("twice"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high", "twice")).alias("asked"))
    one = texts.select("k1", "k2", "text").join(asked, ["k1", "k2"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows()
        for batch in batches:
            k1, k2, asked = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), batch.column("asked").to_pylist()
            for begin, end, data, offsets in chunks(batch.column("text")):
                w.load(data, offsets)
                runs = [(i - begin, a["low"], a["high"], a["twice"]) for i in range(begin, end) for a in asked[i]]
                row, low, high, both = np.array(runs, np.int64).reshape(-1, 4).T
                count = high - low + 1
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                row, both = np.repeat(row, count), np.repeat(both, count)
                h1, h2 = w.hashed(at + w.first[row], at + w.first[row] + w.length)
                yield pa.record_batch({"k1": k1[row + begin], "k2": k2[row + begin], "at": at.astype(np.int32), "h1": h1, "h2": h2, "twice": both.astype(bool)})

    windows = written(one.mapInArrow(extend, "k1 bigint, k2 bigint, at int, h1 bigint, h2 bigint, twice boolean"), "windows")
    repeats = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    single = hot_join(windows.where(~F.col("twice")), repeats, ["h1", "h2"], "n").select("k1", "k2", F.col("at").alias("low"), F.col("at").alias("high"))
    return whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("runs"))


def kept_words(text: str | None, runs: list[dict] | None, length: int = LENGTH) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the words kept, joined by one space."""
    words = (text or "").encode().split()
    if not runs:
        return len(words), 0, b" ".join(words)
    kept, at = [], 0
    for low, high in sorted((r["low"], r["high"]) for r in runs):
        if low > at:
            kept += words[at:low]
        at = max(at, high + length)
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def kept_of_texts(texts: DataFrame) -> DataFrame:
    """(k1, k2, copies, n_words, n_removed, kept) of distinct texts: kept are the words that stay, joined by
    one space."""
    joined = texts.join(repeated_starts(texts), ["k1", "k2"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kept_words(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            own = [batch.column(c) for c in ("k1", "k2", "copies")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["k1", "k2", "copies", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "k1 bigint, k2 bigint, copies bigint, n_words bigint, n_removed bigint, kept string")


def without_repeats(docs: DataFrame, text: str = "text", kept: Column | None = None) -> DataFrame:
    """docs with __n_words, __n_removed and __kept, the words that stay, joined by one space; or what `kept`
    makes of these words (a column over `kept`), worked out once for each distinct text."""
    made = F.col("kept") if kept is None else kept
    found = kept_of_texts(distinct_texts(docs, text)).select("k1", "k2", "copies", "n_words", "n_removed", made.alias("kept"))
    own = [c for c in docs.columns if c not in ("__n_words", "__n_removed", "__kept")]
    a, b = free_names(docs, "__a", "__b")
    keyed = docs.select(*own, *(k.alias(n) for k, n in zip(text_key(F.col(text)), (a, b), strict=True)))
    found = written(found.select(F.col("k1").alias(a), F.col("k2").alias(b), "copies", F.col("n_words").alias("__n_words"), F.col("n_removed").alias("__n_removed"), F.col("kept").alias("__kept")), "kept")
    return hot_join(keyed, found, [a, b], "copies", "inner").select(*own, "__n_words", "__n_removed", "__kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=F.sha2("kept", 256))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept").alias("kept_sha256"))
