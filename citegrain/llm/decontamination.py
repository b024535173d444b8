"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Items are cut into units of at most UNIT words, of nearly equal length, which are what the index holds. A
posting's weight is its BM25 weight divided by the weight of the whole unit, so a score is the share of
the unit's weight that a passage covers: 1 for all of it. Every passage of every document, that is every
run of two half-passages of UNIT words, is a query, so a copy of a unit lies inside some passage. All
units that score `threshold` or more are retrieved.

The search has two levels of block maxima. Units are numbered, and a run of them is a block. For
all passages of a batch at once, the maxima of their terms are added up per block of units; passages
that can't reach the threshold in any block end there, as most do. For the others, block-max WAND
walks the postings: it finds the pivot by the terms' maxima, checks it by the maxima of the postings'
blocks, skips to the end of the shortest block if they don't suffice, and scores it otherwise.

Retrieved items are verified: an item's question is all but its last sentence, its answer the last one
(both are the whole item if it has one sentence). Of each, `overlap` of the words must stand in order
in a stretch little longer than it, near the passages found; `overlap` of the five-word shingles is
enough and tried first. Words are lower case, without ASCII punctuation. Items of fewer than
LEAST_WORDS words are ignored: texts that hold so few words hold them by chance.

The index is built of distinct item texts and sent to executors in shards of bounded size (SHARD_BYTES
of text); with more, documents are searched once per shard. Document frequencies cover all distinct
texts. The ids of items are joined to what was found, so a text that very many items share is one text
in the index.

Nulls and odd input: documents without words are clean; repeated items are reported each, repeated
documents too; a null item id is reported as null. Other columns pass through `decontaminated`;
`contamination` has columns of its own, with the ids in their own types. Empty tables give empty
results, and no item means that every document is clean. Long texts are searched in runs of passages
of bounded size.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain.llm.common import received, sent, table, text_key, written

UNIT, THRESHOLD, OVERLAP, SHINGLE, LEAST_WORDS = 64, 0.6, 0.8, 5, 5
K1, B = 1.2, 0.75
#: Units in a block of the first level; postings in a block of the second; blocks of a term beyond
#: which its overall maximum stands for them.
RUN, BLOCK, WIDE = 4, 16, 64
SHARD_BYTES = 4 << 20
#: Words searched at once; postings that a task keeps as lists.
PIECE, LISTED = 1 << 17, 1 << 20

_PLAIN = bytes(32 if (c < 128 and not chr(c).isalnum()) else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def units_of(words: list[bytes]) -> list[list[bytes]]:
    """The words in as few runs of at most UNIT as there can be, of nearly equal length."""
    n = -(-len(words) // UNIT)
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups starts in a sorted array of group numbers, and the end."""
    return np.searchsorted(of, np.arange(n + 1))


class Index:
    """Postings of the units of some items, as arrays with the start of each term."""

    def __init__(self, items: list[tuple], df: dict[bytes, int] | None = None, n_units: int | None = None, mean: float | None = None) -> None:
        """items: (id, text). df, n_units and mean: of all items, where these are but some."""
        self.items = [(i, *question_and_answer(t)) for i, t in items]
        units = [(at, words) for at, (_, text) in enumerate(items) for words in units_of(words_of(text))]
        self.owner = np.array([at for at, _ in units], np.int64)
        counts = [Counter(words) for _, words in units]
        own: Counter = Counter()
        for c in counts:
            own.update(c.keys())
        df, n_units = df or own, n_units or len(units)
        sizes = np.array([len(w) for _, w in units])
        mean = mean or sizes.sum() / max(1, len(units))
        self.terms = {w: i for i, w in enumerate(sorted(own))}
        unit = np.repeat(np.arange(len(units)), [len(c) for c in counts])
        term = np.fromiter((self.terms[w] for c in counts for w in c), np.int64, len(unit))
        n = np.fromiter((n for c in counts for n in c.values()), np.float64, len(unit))
        seen = np.array([df[w] for w in sorted(own)], np.float64)
        weight = np.log(1 + (n_units - seen + 0.5) / (seen + 0.5))[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * sizes[unit] / mean)) if len(unit) else n
        weight = weight / np.bincount(unit, weight, len(units))[unit] if len(unit) else weight
        order = np.lexsort((unit, term))
        term, self.unit, self.weight = term[order], unit[order].astype(np.int32), weight[order]
        self.start = _starts(term, len(own))
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(own) else np.zeros(0)
        # second level: the last unit and the highest weight of each block of postings of a term
        size = np.diff(self.start)
        first = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(self.start, self.start[1:], strict=False)] or [np.zeros(0, np.int64)])
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.last = self.unit[np.append(first[1:], len(self.unit)) - 1] if len(first) else np.zeros(0, np.int32)
        self.top_start = np.concatenate(([0], np.cumsum(-(-size // BLOCK))))
        # first level: (block of units, maximum) for each term; a wide term's overall maximum stands for them
        self.n_blocks = max(1, math.ceil(len(units) / RUN))
        block = self.unit // RUN
        new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (term[1:] != term[:-1])))) if len(term) else np.zeros(0, np.int64)
        by, best = term[new], np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        wide = np.bincount(by, minlength=len(own)) > WIDE
        self.flat = np.where(wide, self.most, 0.0)
        narrow = ~wide[by]
        self.block, self.maximum = block[new][narrow].astype(np.int64), best[narrow]
        self.block_start = _starts(by[narrow], len(own))
        self.lists: dict[int, tuple] = {}
        self.listed = 0

    def postings(self, term: int) -> tuple[list, list, list, list]:
        """Units and weights of a term, and the last unit and top weight of each block, as lists, on which
        single steps are quick; a bounded number of them is kept."""
        if term not in self.lists:
            if self.listed > LISTED:
                self.lists, self.listed = {}, 0
            a, b = self.start[term : term + 2]
            c, d = self.top_start[term : term + 2]
            self.lists[term] = self.unit[a:b].tolist(), self.weight[a:b].tolist(), self.last[c:d].tolist(), self.top[c:d].tolist()
            self.listed += int(b - a)
        return self.lists[term]

    def hopeful(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """Which of n passages can reach the threshold in a block of units, from distinct pairs of
        passage and term."""
        flat = np.bincount(passage, self.flat[term], n)
        count = self.block_start[term + 1] - self.block_start[term]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.block_start[term], count)
        key = np.repeat(passage, count) * self.n_blocks + self.block[at]
        if n * self.n_blocks <= 4 * len(key) + 1_000_000:
            best = np.bincount(key, self.maximum[at], n * self.n_blocks).reshape(n, self.n_blocks).max(axis=1)
        else:
            keys, inverse = np.unique(key, return_inverse=True)
            best = np.zeros(n)
            np.maximum.at(best, keys // self.n_blocks, np.bincount(inverse, self.maximum[at], len(keys)))
        return best + flat >= threshold - 1e-9

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: (unit, score) of every unit that scores the threshold or more."""
        limit = threshold - 1e-9
        ends = float("inf")
        # where each list stands: its unit, the posting, the most a posting weighs, and the postings
        lists = []
        for t in terms:
            own = self.postings(t)
            lists.append([own[0][0], 0, float(self.most[t]), *own])
        found = []

        def move(x: list, unit: float) -> None:
            """x to its first posting at unit or later."""
            x[1] = bisect.bisect_left(x[3], unit, x[1])
            x[0] = x[3][x[1]] if x[1] < len(x[3]) else ends

        while True:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                if x[0] == ends:
                    break
                total += x[2]
                if total >= limit:
                    pivot = i
                    break
            if pivot < 0:
                return found
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            bound, skip = 0.0, ends
            for x in lists[: pivot + 1]:
                k = bisect.bisect_left(x[5], unit)
                if k < len(x[5]):
                    bound += x[6][k]
                    skip = min(skip, x[5][k] + 1)
            if bound < limit:
                # no unit before the end of the shortest block, or before the next list's unit, can do
                if pivot + 1 < len(lists):
                    skip = min(skip, lists[pivot + 1][0])
                skip = max(skip, unit + 1)
                for x in lists[: pivot + 1]:
                    if x[0] < skip:
                        move(x, skip)
            elif lists[0][0] == unit:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += x[4][x[1]]
                    move(x, unit + 1)
                if score >= limit:
                    found.append((unit, score))
            else:
                for x in lists[: pivot + 1]:
                    if x[0] < unit:
                        move(x, unit)

    def passages(self, texts: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, unit, score) of all passages of the texts that retrieve something."""
        get = self.terms.get
        for begin, pieces in _pieces(texts):
            term = np.fromiter((get(w, -1) for t, lo, hi in pieces for w in texts[t][lo:hi]), np.int64)
            sizes = np.array([hi - lo for _, lo, hi in pieces])
            halves = np.maximum(1, -(-sizes // UNIT))
            counts = np.maximum(1, halves - 1)  # passages of each piece
            first = np.cumsum(counts) - counts
            piece = np.repeat(np.arange(len(pieces)), sizes)
            half = (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // UNIT
            known = term >= 0
            piece, half, term = piece[known], half[known], term[known]
            # a half is in the passage that it begins and in the one before
            own = first[piece] + np.minimum(half, counts[piece] - 1)
            before = first[piece] + np.maximum(0, half - 1)
            n, v = int(counts.sum()), len(self.terms)
            key = np.unique(np.concatenate([own * v + term, before * v + term])) if v else np.zeros(0, np.int64)
            passage, term = key // max(1, v), key % max(1, v)
            hopeful = self.hopeful(passage, term, n, threshold)
            bounds = np.searchsorted(passage, np.arange(n + 1))
            of = np.repeat(np.arange(len(pieces)), counts)
            for p in np.flatnonzero(hopeful).tolist():
                text, lo, _ = pieces[of[p]]
                for unit, score in self.search(term[bounds[p] : bounds[p + 1]].tolist(), threshold):
                    yield text, lo + (p - int(first[of[p]])) * UNIT, unit, score

    def contaminated(self, texts: list[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, object, float, float, float]]:
        """(text, item id, score, overlap with the question, with the answer) of verified matches."""
        words = [words_of(t) for t in texts]
        found: dict[tuple[int, int], list] = {}
        for text, at, unit, score in self.passages(words, threshold):
            x = found.setdefault((text, int(self.owner[unit])), [at, at, 0.0])
            x[0], x[1], x[2] = min(x[0], at), max(x[1], at), max(x[2], score)
        out = []
        for (text, item), (low, high, score) in sorted(found.items()):
            id_, question, answer = self.items[item]
            near = len(question) + len(answer)
            region = words[text][max(0, low - near) : high + 2 * UNIT + near]
            shares = [share(part, region, overlap) for part in (question, answer)]
            if min(shares) >= overlap:
                out.append((text, id_, score, *shares))
        return out


def _pieces(texts: list[list[bytes]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Runs of (text, from, to) of about PIECE words; a long text goes on half a passage before where
    it was cut."""
    held, size = [], 0
    for t, words in enumerate(texts):
        lo = 0
        while True:
            hi = min(len(words), lo + PIECE)
            if hi > lo:
                held.append((t, lo, hi))
                size += hi - lo
            if size >= PIECE:
                yield 0, held
                held, size = [], 0
            if hi == len(words):
                break
            lo = hi - UNIT
    if held:
        yield 0, held


def share(part: list[bytes], region: list[bytes], enough: float = OVERLAP) -> float:
    """How much of part is in region: the share of its five-word shingles if that is enough, else the
    most of its words that stand in order in a stretch a quarter longer than part, whichever is more."""
    k = min(SHINGLE, len(part))
    if not k:
        return 1.0
    there = {tuple(region[i : i + k]) for i in range(len(region) - k + 1)}
    own = [tuple(part[i : i + k]) for i in range(len(part) - k + 1)]
    best = sum(s in there for s in own) / len(own)
    if best >= enough:
        return best
    width = len(part) + max(2, len(part) // 4)
    for at in range(0, max(1, len(region) - len(part) + 1), max(1, len(part) // 8)):
        best = max(best, _in_order(part, region[at : at + width]) / len(part))
        if best >= enough:
            break
    return best


def _in_order(part: list[bytes], other: list[bytes]) -> int:
    """The length of the longest common subsequence, with a bit for each word of part."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    left = whole = (1 << len(part)) - 1
    for w in other:
        hit = left & at.get(w, 0)
        left = (left + hit | left - hit) & whole
    return len(part) - left.bit_count()


def _indexes(items: DataFrame, text: str) -> Iterator[Index]:
    """An index for each shard of the distinct texts; a unit's item is (k1, k2) of its text."""
    items = items.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().select(*text_key(F.col("text")), "text")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = math.ceil(size / SHARD_BYTES)

    def collected(own: DataFrame) -> list[tuple]:
        """Bounded by SHARD_BYTES."""
        found = [((r["k1"], r["k2"]), r["text"]) for r in own.collect()]
        return sorted(x for x in found if len(words_of(x[1])) >= LEAST_WORDS)

    if shards <= 1:
        if found := collected(items) if size else []:
            yield Index(found)
        return

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for t in batch.column("text").to_pylist() if len(w := words_of(t)) >= LEAST_WORDS]
            units = [u for w in words for u in units_of(w)]
            seen = Counter(w for u in units for w in set(u))
            yield pa.record_batch({"term": pa.array([*seen, None], pa.binary()), "n": pa.array([*seen.values(), len(units)], pa.int64()), "words": pa.array([0] * len(seen) + [sum(map(len, units))], pa.int64())})

    counts = written(items.mapInArrow(count, "term binary, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
    whole = counts.where("term IS NULL").first()
    items = written(items.withColumn("shard", F.pmod("k1", F.lit(shards))), "items")
    for s in range(shards):
        own = items.where(F.col("shard") == s)
        terms = own.mapInArrow(count, "term binary, n bigint, words bigint").select("term").where("term IS NOT NULL").distinct()
        df = {bytes(r["term"]): r["n"] for r in counts.join(terms, "term").select("term", "n").collect()}
        if df:
            yield Index(collected(own), df, whole["n"], whole["words"] / whole["n"])


#: Texts that are searched at once.
TEXTS = 500


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and item in it."""
    found, numbers = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)]), ("score", "question_overlap", "answer_overlap")
    for name, kind in (("k1", T.LongType()), ("k2", T.LongType()), *((n, T.DoubleType()) for n in numbers)):
        found = found.add(name, kind)
    out = docs.sparkSession.createDataFrame([], found)
    for index in _indexes(items, item_text):
        index_sent = sent(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], index_sent=index_sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = received(index_sent)
            for whole in batches:
                for k in range(0, whole.num_rows, TEXTS):
                    batch = whole.slice(k, TEXTS)
                    hits = own.contaminated(batch.column("text").to_pylist())
                    rows, keys, *rest = zip(*hits, strict=True) if hits else ((),) * 5
                    one, two = zip(*keys, strict=True) if keys else ((), ())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *(pa.array(r, pa.float64()) for r in rest)], ["doc_id", "k1", "k2", *numbers])

        part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, found)
        out = out.unionByName(part)
    held = items.where(F.col(item_text).isNotNull()).select(*text_key(F.col(item_text)), F.col(item_id).alias("item_id"))
    return out.join(held, ["k1", "k2"]).select("doc_id", "item_id", *numbers)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """docs without those that hold an item."""
    for index in _indexes(items, item_text):
        index_sent = sent(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], index_sent=index_sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = received(index_sent)
            for whole in batches:
                for k in range(0, whole.num_rows, TEXTS):
                    batch = whole.slice(k, TEXTS)
                    clean = np.ones(batch.num_rows, bool)
                    clean[[t for t, *_ in own.contaminated(batch.column(text).to_pylist())]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
