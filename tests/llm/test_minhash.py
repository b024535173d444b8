"""Near copies by Jaccard similarity, against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from citegrain.llm import minhash


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def groups(n, alike):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if alike(i, j):
                up[top(i)] = top(j)
    return [top(i) for i in range(n)]


def parted(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(x, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_the_pipeline_drops_copies_of_similarity_just_above_its_bound_and_no_others(spark):
    """Five changed words that stand apart leave a similarity of 0.8 to 0.85; eight leave about 0.7."""
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(250)]
        near, far = w.copy(), w.copy()
        for k in range(5):
            near[20 + 45 * k] = "new"
        for k in range(9):
            far[20 + 25 * k] = "other"
        texts += [" ".join(x) for x in (w, near, far)]
    jaccard = lambda i, j: len(shingles(texts[i]) & shingles(texts[j])) / len(shingles(texts[i]) | shingles(texts[j]))
    assert all(0.8 <= jaccard(i, i + 1) < 0.85 and jaccard(i, i + 2) < 0.8 for i in range(0, 120, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert kept == {i for i in range(120) if i % 3 != 1}


@pytest.mark.parametrize("seed", range(3))
def test_links_of_a_bucket_join_what_any_pair_joins(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(60):
        base = set(rng.sample(range(10**9), 40)) if not sets or rng.random() < 0.3 else set(rng.choice(sets))
        for _ in range(rng.randint(0, 5)):
            base.discard(rng.choice(sorted(base)))
            base.add(rng.randrange(10**9))
        sets.append(base)
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    want = groups(len(sets), alike)
    given = [want[i] if i % 3 == 0 else 1000 + i for i in range(len(sets))]  # some are joined already
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    links = set(minhash.bucket_links(arrays, given))
    assert all(alike(a, b) for a, b in links)
    found = groups(len(sets), lambda i, j: given[i] == given[j] or (i, j) in links or (j, i) in links)
    assert parted(found) == parted(want)


@pytest.mark.parametrize("block", [2000, 4, 1])
def test_chains_of_near_copies_are_one(spark, monkeypatch, block):
    """Neighbours are alike, ends are not: the first text of a bucket doesn't reach all. Also where buckets
    are cut into blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        w = w.copy()
        for k in range(3):
            w[10 + 15 * i + 3 * k] = f"x{i}-{k}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r["doc_id"] for r in minhash.one_of_each(docs).collect()] == [0]


def test_pairs_of_blocks_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rooted = spark.createDataFrame([(b, n, n, 10 if b else 3) for b in (0, 1) for n in range(10 if b else 3)], "bucket bigint, node bigint, root bigint, size bigint")
    tasks = {}
    for r in minhash.blocked(rooted).collect():
        tasks.setdefault((r["bucket"], r["block"], r["other"]), set()).add(r["node"])
    for b, n in ((0, 3), (1, 10)):
        together = {(x, y) for (k, *_), own in tasks.items() if k == b for x in own for y in own}
        assert together >= {(x, y) for x in range(n) for y in range(n)}
    assert len([k for k in tasks if k[0] == 0]) == 1


def test_near_copies_odd_texts(docs, none):
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 1 not in ids and 2 not in ids and ids.count(None) == 1
    assert minhash.one_of_each(none).count() == 0
