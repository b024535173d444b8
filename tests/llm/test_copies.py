"""Substring dedup, SimHash near-dedup and components, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citegrain.llm import common, components, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_brute_force(texts, length=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def removed(df):
    return sorted((r["__n_words"], r["__n_removed"], r["__kept"]) for r in df.collect())


def test_substrings_odd_texts(docs, none):
    out = substring_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "__n_words", "__n_removed", "__kept"]
    assert removed(out) == sorted(kept_by_brute_force([r["text"] for r in docs.collect()]))
    assert substring_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_random_mosaics(spark, seed):
    """Texts made of shared pieces of lengths about the threshold, over a small alphabet."""
    rng = random.Random(seed)
    pieces = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(20, 50))] for _ in range(8)]
    texts = []
    for _ in range(40):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += rng.choice(pieces) if rng.random() < 0.7 else [rng.choice("xyz") + str(rng.random()) for _ in range(rng.randint(1, 30))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert removed(substring_dedup.without_repeats(docs)) == sorted(kept_by_brute_force(texts))


def fingerprint(text, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_brute_force(fps, budget):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_fingerprints():
    for t in (None, "", "one", "A b c", "a b c d", "É a\u0085b c d e f", "x " * 200_000):
        if len(t or "") < 1000:
            assert simhash.fingerprint(t or "") == fingerprint(t)
    assert simhash.fingerprint("x " * 200_000) == fingerprint("x x x x")


def test_simhash_odd_texts(docs, none, spark):
    rows, roots = simhash.near_duplicates(docs)
    got = {r["id"]: r["node"] for r in rows.collect()}
    for r in docs.collect():
        if len(r["text"] or "") < 10_000:
            assert got[r["doc_id"]] & (2**64 - 1) == fingerprint(r["text"])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 1 not in ids and 2 not in ids and ids.count(None) == 1
    assert simhash.one_of_each(none).count() == 0


def clusters(rng, n):
    """Fingerprints in chains, stars and dense groups."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    dense = rng.getrandbits(64)
    return list({*out, *(dense ^ rng.getrandbits(10) for _ in range(300)), 0, 2**64 - 1})


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_all_components_of_one_bucket(seed):
    fps = np.sort(np.array(clusters(random.Random(seed), 150), np.uint64))
    for budget in (0, 2, 4, 7):
        zeros = np.zeros(len(fps), np.int64)
        links = fps[simhash.trie_links(zeros, zeros, zeros, fps, 0, budget)]
        assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= budget).all()
        assert len(links) < len(fps)
        at = {int(x): i for i, x in enumerate(fps)}
        up = list(range(len(fps)))

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links.tolist():
            x, y = top(at[a]), top(at[b])
            up[max(x, y)] = min(x, y)
        assert [top(i) for i in range(len(fps))] == roots_by_brute_force([int(x) for x in fps], budget)


@pytest.mark.parametrize(("choose", "limits"), [(1, {}), (2, {}), (1, {"JOB_ROWS": 20, "GROUP_ROWS": 8}), (1, {"JOB_ROWS": 5, "GROUP_ROWS": 1}), (2, {"JOB_ROWS": 30, "GROUP_ROWS": 30, "HAND_BITS": 1})])
def test_links_over_blocks_find_all_components(spark, monkeypatch, choose, limits):
    """Also where most jobs are too large for a task, and are handed on several times."""
    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    fps = clusters(random.Random(9), 200)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) * 2 for x in fps], "fp bigint, node bigint")
    assert len(simhash.block_choices(10**6, 8)) == 165 and len(simhash.block_choices(10**4, 4)) == 5
    n = {1: len(fps), 2: 10**7}[choose]  # more fingerprints choose more blocks; the links are the same
    found = components.components(simhash.fingerprint_links(df, n))
    root = {r["node"]: r["root"] for r in found.collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    want = roots_by_brute_force(fps, 4)
    groups, expected = {}, {}
    for i, s in enumerate(signed):
        groups.setdefault(root.get(s, s), set()).add(i)
        expected.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_stars_and_nothing(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*path, *star, (7, 7), (2, 1)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1
    assert components.components(links.limit(0)).count() == 0


def test_near_copies_are_one_and_half_copies_are_not(spark):
    """A share 2J / (1 + J) of common shingles, as a cosine, gives the chance that a bit differs: at J =
    0.93 it is 0.084, so a link is missed with the chance that more than 8 of 64 do, 0.08. Of 60 pairs
    that is 5, and more than 12 once in a thousand times."""
    rng = random.Random(4)
    rows, want = [], []
    for i in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows.append((i, " ".join(w)))
        edited = w.copy()
        for k in range(2):  # two words: 10 of 296 shingles change
            edited[50 + 100 * k] = "new"
        rows.append((100 + i, " ".join(edited)))
        far = w.copy()
        for k in range(0, 300, 10):  # half of the shingles change
            far[k] = f"x{k}"
        rows.append((200 + i, " ".join(far)))
        want += [i, 200 + i]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(docs, shingle=5, budget=8).collect()}
    assert set(want) <= kept
    assert len(kept - set(want)) <= 12


def test_hot_keys_join_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k int, v int")
    keys = rows.groupBy("k").count().where("k <> 3").withColumn("x", F.col("k") * 2)
    want = {how: sorted(map(tuple, rows.join(keys.drop("count"), ["k"], how).collect()), key=repr) for how in ("left_semi", "inner", "left")}
    for hot, most in ((10**9, 5), (50, 5), (1, 100), (1, 2)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_KEYS", most)
        for how, w in want.items():
            assert sorted(map(tuple, common.hot_join(rows, keys, ["k"], "count", how).collect()), key=repr) == w


def test_names_that_clash(spark, docs):
    """Columns named like inner ones pass through."""
    clash = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("__a", "__B", "__k1", "copies", "kept", "__n_words", "__key", "__id", "__head"))])
    out = substring_dedup.without_repeats(clash)
    assert out.columns == [*(c for c in clash.columns if c != "__n_words"), "__n_words", "__n_removed", "__kept"]
    assert out.select("__a", "__B", "__k1", "copies", "kept").distinct().collect() == [(0, 1, 2, 3, 4)]
    assert removed(out) == sorted(kept_by_brute_force([r["text"] for r in docs.collect()]))
    kept = simhash.one_of_each(clash)
    assert kept.columns == clash.columns and kept.select("__key", "__id", "__head").distinct().collect() == [(6, 7, 8)]
