"""Near copies by the Jaccard similarity of word shingles: SimHash's trie and MinHash find candidates, sets
decide.

A text is the set of the 64-bit hashes of its word shingles (ASCII letters in lower case). The SimHash
fingerprints of the sets are joined by the trie of simhash, which finds the closest copies, but at a
similarity of 0.8 about ten bits differ, beyond any budget that a trie can afford. So of each set
BANDS x ROWS minima of hash functions are taken too; texts that agree in all minima of a band meet
in a bucket. At a similarity of 0.8 two texts miss each other in every band with a chance of
(1 - 0.8^6)^24 = 0.0007. Links are decided by the sets themselves, so no link is an estimate.

A bucket never emits all its pairs. First each text is compared with one text of each of its
buckets, by joins, which settles groups of near copies at about their size. Only buckets that
still hold several components, and more than one pair, are then looked at whole: the members of a
component are compared in turn with what is outside it, until nothing is added, so that all links
inside a bucket are found but for those within a component. Two sets can be as alike as that only if
they share one of their rarest hashes, so only those are compared. A bucket of more than BLOCK members
is cut into blocks, and each pair of blocks is looked at apart, so no task holds more than two.

Nulls and odd input: a null text is empty; texts without words are alike; with fewer words than a
shingle's the whole sequence is the one shingle. Repeated rows and texts with equal sets share a
node. Rows with a null id take part. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import WordKernel, hot_join, mixed, written
from citegrain.llm.components import components
from citegrain.llm.simhash import bit_counts, fingerprint_links, majority, smallest_of_each

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 24, 6
#: Shingles whose minima are taken at once; members of a block of a large bucket.
PIECE, BLOCK = 1 << 12, 2000

_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None] | np.uint64(1)
_OFFSETS = mixed(np.arange(10_001, BANDS * ROWS + 10_001, dtype=np.uint64))[:, None]


def shingle_set(text: str, kernel: WordKernel, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode(errors="surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = kernel.bounds(data)
    return np.unique(kernel.hashes(data, starts[: max(1, len(words) - shingle + 1)], ends[min(shingle, len(words)) - 1 :]))


def bands(found: np.ndarray) -> np.ndarray:
    """The buckets of a set: a hash of the number and the minima of each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), PIECE):
        least = np.minimum(least, (found[i : i + PIECE] * _FACTORS + _OFFSETS).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return out


def _node(found: np.ndarray) -> np.uint64:
    return np.bitwise_xor.reduce(mixed(found)) ^ mixed(np.array([len(found)], np.uint64))[0]


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes."""
    return majority(sum(bit_counts(found[i : i + PIECE]) for i in range(0, len(found), PIECE)), len(found))


def with_bands(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, key, node, fp, buckets): the text's hash, a name for its set, the set's fingerprint and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = WordKernel()
        for batch in batches:
            sets = (shingle_set(t or "", kernel, shingle) for t in batch.column("text").to_pylist())
            every = [(_node(s), set_fingerprint(s), bands(s)) for s in sets]
            node, fp = (np.array([x[i] for x in every], np.uint64).view(np.int64) for i in (0, 1))
            values = np.array([b for *_, b in every], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1, dtype=np.int32) * BANDS), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(node), pa.array(fp), lists], ["id", "key", "node", "fp", "buckets"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, key bigint, node bigint, fp bigint, buckets array<bigint>")


def with_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of each row of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = WordKernel()
        for batch in batches:
            sets = [shingle_set(t or "", kernel, shingle) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "hashes"])

    return texts.mapInArrow(run, "node bigint, hashes array<bigint>")


def _rarest(sets: list[np.ndarray], least: float) -> list[np.ndarray]:
    """Of each set the hashes that are in the fewest sets, so many that two sets of that similarity share one."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((at, counts[at], owner))
    place = np.arange(len(order)) - np.searchsorted(owner, owner)  # owner is sorted, so is it after ordering
    size = np.bincount(owner)
    most = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    kept = order[place < most[owner]]
    return np.split(at[kept], np.cumsum(np.bincount(owner[kept], minlength=len(sets)))[:-1])


def bucket_links(sets: list[np.ndarray], roots: list[int], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that join all parts of a bucket that any pair of at least that similarity joins; sets of
    one root are joined already."""
    sizes = np.array([len(s) for s in sets])
    label = np.unique(roots, return_inverse=True)[1]
    rare = _rarest(sets, least)
    holders: dict[int, list[int]] = {}
    for i, own in enumerate(rare):
        for h in own.tolist():
            holders.setdefault(h, []).append(i)
    members = [np.flatnonzero(label == k).tolist() for k in range(label.max() + 1)] if len(sets) else []
    out = []
    left = np.ones(len(sets), bool)
    for i in range(len(sets)):
        if not left[i]:
            continue
        part = list(members[label[i]])
        left[part] = False
        for a in part:  # grows
            near = np.unique([b for h in rare[a].tolist() for b in holders[h]])
            near = near[left[near] & (np.minimum(sizes[near], sizes[a]) >= least * np.maximum(sizes[near], sizes[a]))]
            for b in near.tolist():
                if not left[b]:
                    continue
                at = np.minimum(np.searchsorted(sets[a], sets[b]), sizes[a] - 1)
                common = int((sets[a][at] == sets[b]).sum())
                if common >= least * (sizes[a] + sizes[b] - common) - 1e-9:
                    out.append((a, b))
                    left[members[label[b]]] = False
                    part += members[label[b]]
    return out


def mixed_bucket_links(members: DataFrame, least: float) -> DataFrame:
    """(a, b) from (bucket, block, other, node, root, hashes), dealt out by bucket and pair of blocks."""
    keys = ["bucket", "block", "other"]

    def links(nodes: list[int], roots: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(nodes, np.int64)[np.array(bucket_links(sets, roots, least), np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            nodes, roots = (batch.column(c).to_pylist() for c in ("node", "root"))
            for i, key in enumerate(own):
                if key != last and held[0]:
                    yield links(*held)
                    held = ([], [], [])
                last = key
                held[0].append(nodes[i])
                held[1].append(roots[i])
                held[2].append(batch.column("hashes")[i].values.to_numpy().view(np.uint64).copy())
        if held[0]:
            yield links(*held)

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def blocked(rooted: DataFrame) -> DataFrame:
    """(bucket, block, other, node, root) from (bucket, node, root, size): a row for each pair of blocks that a
    member is in; a bucket of up to BLOCK members is one block."""
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64(F.lit(3), "node"), blocks)
    out = rooted.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    # a pair of one block with itself is in every pair that the block is in
    out = out.where((F.col("size") <= BLOCK) | (F.col("own") != F.col("with")))
    return out.select("bucket", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"), "node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, key, node) of each row of docs, and (node, root): root is one node of the component."""
    rows = written(with_bands(docs, doc_id, text, shingle), "bands")
    nodes = written(rows.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "nodes")

    # candidates: one text of each fingerprint with the others, and with those of linked fingerprints
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
    same = hot_join(nodes.select("fp", "node"), heads, ["fp"], "n", "inner").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = fingerprint_links(heads.select("fp", F.col("head").alias("node")), heads.count())
    # and one text of each bucket with the others
    every = nodes.select("node", F.explode("buckets").alias("bucket"))
    buckets = written(every.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "buckets")
    members = written(hot_join(every, buckets, ["bucket"], "n", "inner"), "members")
    met = members.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    pairs = written(met.unionByName(same).unionByName(near).distinct(), "pairs")

    wanted = members.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "key").join(wanted, "node", "left_semi")
    texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).join(wanted, "key").dropDuplicates(["key"])
    sets = written(with_sets(texts.select("node", "text"), shingle), "sets")

    pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    pairs = pairs.withColumn("common", F.size(F.array_intersect("x", "y")))
    links = written(pairs.where(F.col("common") >= least * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b"), "first-links")
    roots = written(components(links), "first-roots")

    rooted = members.where("size > 2").select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    # buckets that several components are in; those with the same members count once
    once = rooted.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y")).where("low != high")
    once = written(once.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size", F.col("size").alias("n")), "mixed-buckets")
    mixed_ = blocked(hot_join(rooted, once, ["bucket"], "n", "inner"))
    more = written(mixed_bucket_links(mixed_.join(sets, "node"), least), "more-links")
    roots = components(links.unionByName(more))
    rooted = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.select("id", "key", "node"), written(rooted, "roots")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs without near copies: of each component, the row with the smallest id stays."""
    return smallest_of_each(docs, *near_duplicates(docs, doc_id, text, shingle, least), doc_id, text)
