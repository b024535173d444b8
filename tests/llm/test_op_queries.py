"""The registered queries and the pipeline over a whole small set of tables, against SQL or brute force."""

import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_copies import WORD, fingerprint, kept_by_brute_force, roots_by_brute_force
from test_minhash import groups, shingles

import corpus_pipeline
from citegrain.llm import decontamination, line_templates, media, packing, queries
from citegrain.llm.common import table

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def rows_of(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_the_oracles(spark, name):
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, out.select(columns).collect()), key=repr) == sorted(want, key=repr)
    assert want and (name != "op2_chat_format" or any(-1 in r for r in want))


def test_op1(spark, texts):
    rows = rows_of(spark, "op1_language_id")
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    right = n = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = texts[r["doc_id"]] or ""
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text))
        if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und":
            n, right = n + 1, right + (langs[r["doc_id"]] == r["lang_pred"])
    assert right >= 0.95 * n > 0


def normal(text):
    return " ".join(w.decode() for w in decontamination.words_of(text))


def test_op3(spark, texts):
    """Every document that holds an item as it stands is found, and what is found holds most of its words."""
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in rows_of(spark, "op3_decontamination")}
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if len(normal(x).split()) >= 5 and f" {normal(x)} " in f" {normal(t)} "}
    assert held and held <= found
    for d, i in found - held:
        for part in decontamination.question_and_answer(items[i]):
            assert decontamination.share(part, decontamination.words_of(texts[d])) >= 0.8


def test_op4(spark, texts):
    rows = rows_of(spark, "op4_media")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    features = defaultdict(set)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.mux(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), sha256(stored).hexdigest()) and payload in stored
        features[r["feature"]].add(payload)
    assert all(len(own) == 1 for own in features.values())  # texts of one length differ in it too


def test_op5(spark, texts):
    ids = sorted(texts)
    want = {i: (n, k, sha256(kept.encode()).hexdigest()) for i, (n, k, kept) in zip(ids, kept_by_brute_force([texts[i] for i in ids]), strict=True)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(spark, "op5_substring_dedup")} == want


def check_packed(rows, texts):
    """Pieces hold every id once, sequences have no gap and at most 4,096 ids, and there are little more of
    them than the ids need; equal to what first-fit of whole rests would take, or fewer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    at, sequences = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["length"] > 0 and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == Counter({d: len(x) for d, x in ids.items()})
    padding = 0
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
        padding += 4096 - end if end & (end - 1) else 0
    bins = []
    for x in sorted((len(x) % 4096 for x in ids.values()), reverse=True):
        fits = next((k for k, b in enumerate(bins) if b + x <= 4096), None)
        if fits is None:
            bins.append(x)
        else:
            bins[fits] += x
    first_fit = sum(4096 - b for b in bins)
    assert padding <= max(0.02 * at.total(), first_fit)


def test_op6(spark, texts):
    check_packed(rows_of(spark, "op6_packing"), texts)


def test_op7(spark, texts):
    ids = sorted(texts)
    fps = [fingerprint(texts[i]) for i in ids]
    want = {i: (f"{fp:016x}", ids[root]) for i, fp, root in zip(ids, fps, roots_by_brute_force(fps, 4), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op7_simhash")} == want


def test_op9(spark, texts):
    rows = rows_of(spark, "op9_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_pipeline(spark):
    """Each stage's rows from its predecessor's by another way."""
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"]: r for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, out, SF), name)
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == out.count() and got.keys() <= kept.keys()
        ids = sorted(kept)
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"] or "") for r in got.values())
            assert all(i in got for i in ids if kept[i]["lang"] and len(WORD.findall(kept[i]["text"] or "")) > 50)
        elif name == "line_dedup":
            con = duckdb.connect()
            before = out.sparkSession.createDataFrame([(i, kept[i]["text"]) for i in ids], "doc_id bigint, text string").toArrow()
            con.register("documents", before)
            want = {r[0]: r[3] for r in con.execute(line_templates.OP8_SQL).fetchall()}
            assert {i: sha256(r["text"].encode()).hexdigest() for i, r in got.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "near_dedup":
            sets = [shingles(re.sub("[A-Z]", lambda m: m[0].lower(), kept[i]["text"])) for i in ids]
            roots = groups(len(ids), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
            want = {min(ids[k] for k in range(len(ids)) if roots[k] == r) for r in set(roots)}
            assert got.keys() == want
        else:
            items = [normal(r["text"]) for r in table(spark, SF, "benchmark").collect() if r["text"]]
            held = {i for i in ids if any(len(x.split()) >= 5 and f" {x} " in f" {normal(kept[i]['text'])} " for x in items)}
            assert not held & got.keys()
            for i in kept.keys() - got.keys() - held:  # what else goes holds most words of an item
                words = decontamination.words_of(kept[i]["text"])
                assert any(all(decontamination.share(p, words) >= 0.8 for p in decontamination.question_and_answer(x)) for x in items)
        kept = got
    rows = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()]
    check_packed(rows, {i: r["text"] for i, r in kept.items()})
    again = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in again if r["length"] == 4096} == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["length"] == 4096}
    assert {r["doc_id"] for r in again} == kept.keys()


def test_workers_need_not_have_the_package(tmp_path):
    """Python workers start from a folder and a path without this repository."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
from citegrain.session import local_session
spark = local_session(4, 4, "4g")
def fails(batches):
    try:
        import citegrain
    except ImportError:
        yield from batches
assert spark.range(3).mapInArrow(fails, "id bigint").count() == 3
for name in ["op1_language_id", "op3_decontamination", "op5_substring_dedup", "op9_sharding", "pipeline", "k16_hurdle"]:
    assert e.queries()[name](spark, {SF!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    keep = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO]
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | ({"PYTHONPATH": os.pathsep.join(keep)} if keep else {}), capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-3000:]
