"""SimHash near-dedup: fingerprints, and a self-join of a binary trie of them.

A fingerprint bit is set if it is set in more than half of the XXH64 hashes of a text's word
shingles. Two texts link if their fingerprints differ in at most `budget` of 64 bits.

The trie is walked by pairs of nodes: from the pair of the root with itself, each step takes the four
pairs of their children, adds the bit in which they differ, and drops pairs beyond the budget. Tasks
share the walk by subtrees: of budget + c blocks of bits c are never touched, so linked fingerprints
are equal in some choice of c blocks. For each choice there is a trie of the bits in an order that puts
these blocks first, in which only the pairs of a node below them with itself are left to walk; such a
subtree is a job. c grows with the number of fingerprints, which keeps jobs small. A job of more than
JOB_ROWS fingerprints isn't held by one task: its rows are handed on to jobs for the pairs of nodes
HAND_BITS further down, with the bits in which these differ, and so on until all jobs fit.

In a job the trie is a sorted array. It gives only links that join parts that weren't joined in it (a
spanning forest), never all its pairs; and pairs of nodes whose leaves all are in one part already are
dropped, so a large group of near copies costs about its size. Equal texts have one fingerprint,
which is joined once however many documents hold it. Links are distributed, and so are the
components formed from them.

Nulls and odd input: a null text is empty; without words the fingerprint is zero, linked like any
other; with fewer words than a shingle's the whole sequence is the one shingle. Repeated rows share
a component. Rows with a null id take part; a component of these alone has a null component_id.
Other columns don't matter, an empty table gives an empty result, and a very long text is hashed in
pieces of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm.common import free_names, hot_join, mixed, table, written
from citegrain.llm.components import components

BITS, BUDGET, SHINGLE, SEED = 64, 4, 4, 42
#: Shingles hashed at once; rows of jobs in a partition; rows of jobs, and pairs of nodes, that are
#: worked on at once; pairs of leaves that are compared directly.
PIECE, PARTITION_ROWS, GROUP_ROWS, PAIRS, LEAVES = 1 << 16, 400_000, 40_000, 1 << 17, 64
#: Fingerprints in a job, about, beyond which more blocks are chosen; those that a task holds at most;
#: bits that a larger job is handed on by.
BUCKET, JOB_ROWS, HAND_BITS = 128, 1_000_000, 4


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: A-Z alone change, and only the six ASCII spaces split
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(starts), PIECE):
        h = np.array([hashed(data[a:b], SEED) for a, b in zip(starts[i : i + PIECE], ends[i : i + PIECE], strict=True)], np.uint64)
        ones += bit_counts(h)
    return majority(ones, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that more than half of n hashes have."""
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, key, fp): the text's hash and the bits of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fp.view(np.int64))], ["id", "key", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, key bigint, fp bigint")


class Parts:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def labels(self) -> np.ndarray:
        while (self.up != (next_ := self.up[self.up])).any():
            self.up = next_
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins the pairs; those that weren't joined before."""
        labels, new = self.labels(), []
        apart = labels[a] != labels[b]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for i, j, x, y in zip(a[apart].tolist(), b[apart].tolist(), labels[a[apart]].tolist(), labels[b[apart]].tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                new.append((i, j))
        if up:
            at = np.fromiter(up, np.int64, len(up))
            self.up[at] = [top(x) for x in at.tolist()]
        return new


def trie_links(jobs: np.ndarray, sides: np.ndarray, diffs: np.ndarray, fps: np.ndarray, depth: int = 0, budget: int = BUDGET) -> np.ndarray:
    """A spanning forest of the links of each job, as pairs of places. The rows are sorted by job, side and
    fingerprint (uint64). Side 0 is joined with itself, side 1 with side 2; the fingerprints of a side
    agree in the first `depth` bits, and the sides differ in `diffs` of these."""
    n = len(fps)
    edges = np.concatenate(([0], np.flatnonzero(jobs[1:] != jobs[:-1]) + 1, [n]))
    parts, found = Parts(n), []
    ones: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)))
        return ones[bit]

    def link(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
        found.extend(parts.join(i[near], j[near]))

    # neighbours in the sorted order first, so that large groups are joined early
    i = np.flatnonzero(jobs[1:] == jobs[:-1])
    link(i, i + 1)
    # columns: start and end of either node's leaves, and the bits in which the nodes differ
    start, end = edges[:-1], edges[1:]
    second = np.concatenate(([0], np.cumsum(sides == 2)))
    middle = end - (second[end] - second[start])
    own = sides[start] == 0
    first = np.stack([start, np.where(own, end, middle), np.where(own, start, middle), end, diffs[start]], axis=1)
    first = first[(first[:, 1] > first[:, 0]) & (first[:, 3] > first[:, 2])]
    stack = [(depth, first)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > PAIRS:
            stack += [(depth, pairs[PAIRS:]), (depth, pairs[:PAIRS])]
            continue
        labels = parts.labels()
        turns = np.concatenate(([0], np.cumsum(labels[1:] != labels[:-1])))
        a0, a1, b0, b1, _ = pairs.T
        done = (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0]) & (labels[a0] == labels[b0])
        pairs = pairs[~done]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAVES
        if depth == BITS:
            small[:] = True
        if small.any():
            a0, a1, b0, b1, _ = pairs[small].T
            width = b1 - b0
            count = (a1 - a0) * width
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = np.repeat(a0, count) + at // np.repeat(width, count), np.repeat(b0, count) + at % np.repeat(width, count)
            link(i[i < j], j[i < j])
            pairs = pairs[~small]
        if len(pairs):
            before = ones_before(depth)
            a0, a1, b0, b1, d = pairs.T
            am, bm, same = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0]), a0 == b0
            children = np.concatenate([
                np.stack([a0, am, b0, bm, d], axis=1),
                np.stack([am, a1, bm, b1, d], axis=1),
                np.stack([a0, am, bm, b1, d + 1], axis=1),
                np.stack([am, a1, b0, bm, d + 1], axis=1)[~same],
            ])
            some = (children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2]) & (children[:, 4] <= budget)
            alone = (children[:, 0] == children[:, 2]) & (children[:, 1] - children[:, 0] == 1)
            stack.append((depth + 1, children[some & ~alone]))
            if not len(stack[-1][1]):
                stack.pop()
    return np.array(found, np.int64).reshape(-1, 2)


def block_choices(n: int, budget: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks, as runs of bits, one of which is equal in any two linked fingerprints; of as
    many blocks as make about BUCKET of n fingerprints equal by chance, at most."""
    c = 1
    while n / 2 ** (BITS * c / (budget + c)) > BUCKET and c < 4:
        c += 1
    bounds = [round(i * BITS / (budget + c)) for i in range(budget + c + 1)]
    return [list(x) for x in combinations(list(zip(bounds, bounds[1:], strict=False)), c)]


def _bits(runs: list[tuple[int, int]]) -> Column:
    """These runs of bits of fp, one after another, as a number."""
    out = F.lit(0).cast("bigint")
    for low, high in runs:
        own = F.shiftrightunsigned("fp", BITS - high)
        own = own if high - low == BITS else own.bitwiseAND(F.lit((1 << (high - low)) - 1))
        out = F.shiftleft(out, high - low).bitwiseOR(own)
    return out


def _jobs(nodes: DataFrame, choices: list[list[tuple[int, int]]]) -> DataFrame:
    """(job, side, diff, fp, node) of nodes (fp, node): for each choice the fingerprint with the chosen bits
    first, which name the job."""
    rows = []
    for i, blocks in enumerate(choices):
        edges = [0, *(x for block in blocks for x in block), BITS]
        others = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
        rows.append(F.struct(_bits(blocks).bitwiseOR(F.lit(i << 48)).alias("job"), _bits(blocks + others).alias("fp")))
    return nodes.select("node", F.inline(F.array(*rows))).select("job", F.lit(0).alias("side"), F.lit(0).alias("diff"), "fp", "node")


_HANDED = ("job", "side", "diff", "fp", "node")


def _handed_on(rows: np.ndarray, depth: int, budget: int) -> pa.RecordBatch:
    """Rows (job, side, diff, fp, node) of a job, for the jobs of the pairs of nodes HAND_BITS further down."""
    child = (rows[:, 3].view(np.uint64) >> np.uint64(BITS - depth - HAND_BITS)).astype(np.int64) & ((1 << HAND_BITS) - 1)
    out = []
    for other in range(1 << HAND_BITS):
        low, high = np.where(rows[:, 1] == 2, other, child), np.where(rows[:, 1] == 2, child, other)
        side = rows[:, 1].copy()
        own = rows[:, 1] == 0  # a job of one side: the pairs of its nodes, the lower one first
        side[own] = np.where(child[own] == other, 0, np.where(child[own] < other, 1, 2))
        low[own], high[own] = np.minimum(child[own], other), np.maximum(child[own], other)
        diff = rows[:, 2] + np.bitwise_count(low ^ high)
        job = mixed(mixed(rows[:, 0].view(np.uint64)) ^ (low << HAND_BITS | high).astype(np.uint64) + np.uint64(1)).view(np.int64)
        out.append(np.stack([job, side, diff, rows[:, 3], rows[:, 4]], axis=1)[diff <= budget])
    every = np.concatenate(out)
    none = pa.nulls(len(every), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, *(pa.array(np.ascontiguousarray(c)) for c in every.T)], ["a", "b", *_HANDED])


def _links(rows: np.ndarray, depth: int, budget: int) -> pa.RecordBatch:
    """Links of whole jobs."""
    rows = rows[np.lexsort((rows[:, 3].view(np.uint64), rows[:, 1], rows[:, 0]))]
    pairs = trie_links(rows[:, 0], rows[:, 1], rows[:, 2], np.ascontiguousarray(rows[:, 3]).view(np.uint64), depth, budget)
    out = rows[pairs, 4]
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), *[pa.nulls(len(out), pa.int64())] * 5], ["a", "b", *_HANDED])


def _walked(rows: DataFrame, depth: int, budget: int, partitions: int) -> DataFrame:
    """(a, b) of links, or rows of jobs that are handed on, of all jobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, too_large = [], 0, None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy() for c in _HANDED], axis=1)
            if too_large is not None:  # the rest of a job that goes on to others
                end = int(np.searchsorted(new[:, 0] != too_large, True))
                if end:
                    yield _handed_on(new[:end], depth, budget)
                new = new[end:]
                if not len(new):
                    continue
                too_large = None
            held.append(new)
            size += len(new)
            if size >= GROUP_ROWS:
                rows = np.concatenate(held)
                last = int(np.searchsorted(rows[:, 0] == rows[-1, 0], True))  # the last job may go on
                if last:
                    yield _links(rows[:last], depth, budget)
                held, size = [rows[last:]], len(rows) - last
                if size > JOB_ROWS:
                    too_large = rows[-1, 0]
                    for i in range(last, len(rows), GROUP_ROWS):
                        yield _handed_on(rows[i : i + GROUP_ROWS], depth, budget)
                    held, size = [], 0
        if held:
            yield _links(np.concatenate(held), depth, budget)

    rows = rows.repartition(partitions, "job").sortWithinPartitions("job", "side")
    return rows.mapInArrow(run, "a bigint, b bigint, " + ", ".join(f"{c} bigint" for c in _HANDED))


def fingerprint_links(nodes: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """(a, b): links that join all nodes (fp, node) within the budget, of which there are n."""
    choices = block_choices(n, budget)
    partitions = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(choices) / PARTITION_ROWS))
    depth = min(sum(high - low for low, high in blocks) for blocks in choices)
    rows, found = _jobs(nodes, choices).select(*[F.col(c).cast("bigint").alias(c) for c in _HANDED]), []
    while True:
        out = written(_walked(rows, depth, budget, partitions), "links")
        found.append(out.where("a IS NOT NULL").select("a", "b"))
        rows, depth = out.where("a IS NULL").select(*_HANDED), depth + HAND_BITS
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(id, key, node) of each row of docs, the node being its fingerprint, and (node, root): root is one
    node of the component."""
    rows = written(with_fingerprints(docs, doc_id, text, shingle).withColumnRenamed("fp", "node"), "fingerprints")
    nodes = written(rows.select(F.col("node").alias("fp"), "node").distinct(), "nodes")
    roots = components(fingerprint_links(nodes, nodes.count(), budget))
    rooted = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows, written(rooted, "roots")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """docs without near duplicates: of each component, the row with the smallest id stays (a null
    id only if there is no other; then the smallest hash of the text)."""
    return smallest_of_each(docs, *near_duplicates(docs, doc_id, text, shingle, budget), doc_id, text)


def smallest_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component, the row with the smallest id; rows has (id, key, node), roots (node, root)."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    heads = rows.groupBy("node").agg(F.min(order).alias("head")).join(roots, "node").groupBy("root").agg(F.min("head").alias("head"))
    a, b = free_names(docs, "__id", "__head")
    key = free_names(docs, "__key")[0]
    heads = heads.select(F.col("head.id").alias(a), F.col("head.key").alias(b))
    keyed = docs.withColumn(key, F.xxhash64(text))
    kept = keyed.join(heads, F.col(doc_id).cast("bigint").eqNullSafe(F.col(a)) & (F.col(key) == F.col(b)), "left_semi")
    return kept.dropDuplicates([doc_id, key]).select(docs.columns)


def component_ids(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (id, key, node) with component_id, the smallest id of the component. Rows of hot nodes and of
    hot components aren't gathered."""
    least = rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n")).join(roots, "node")
    least = written(least, "least")
    of_root = written(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "components")
    named = hot_join(least.select("root", "node", "n"), of_root, ["root"], "nodes", "inner").select("node", "component_id", "n")
    return hot_join(rows, written(named, "named"), ["node"], "n", "inner")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = component_ids(*near_duplicates(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
