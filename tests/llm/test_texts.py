"""Language ID, decontamination, media, packing, sharding and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.llm import cutting_stock, decontamination, language_id, media, packing, sharding
from citegrain.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    filters = language_id.fit(docs.where(language_id.training(docs)).select("doc_id", "text", "lang"))
    out = language_id.identify(docs.where(~language_id.training(docs)), filters)
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.98


def test_languages_of_odd_texts(docs, none):
    filters = language_id.fit(docs.where(language_id.training(docs)).select("doc_id", "text", "lang"))
    out = language_id.identify(docs, filters)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    rows = out.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [by[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    assert language_id.identify(none, filters).count() == 0
    untaught = language_id.fit(none.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(docs, untaught).collect()} == {"und"}


def test_filters_are_corrected_for_false_positives():
    rng = np.random.default_rng(1)
    filters = language_id.Filters([f"l{i:02}" for i in range(70)], bits=10)
    grams = [rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(70)]
    for i, g in enumerate(grams):
        filters.add(i, g)
    assert filters.slots.shape == (2, 1024)
    masks = filters.masks(grams[68])
    assert (masks[1] >> np.uint64(4) & np.uint64(1)).all()  # nothing that was added is missed
    other = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    seen = (filters.masks(other)[1] >> np.uint64(4) & np.uint64(1)).mean()
    assert seen == pytest.approx(filters.false_rates()[68], abs=0.02)


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    filters = language_id.Filters(["a", "b"])
    letters = language_id.Letters()
    for i, t in enumerate(("abcd efgh abba", "xyz zyx yyz")):
        ((points, _),) = letters.pieces(t)
        filters.add(i, np.concatenate([language_id.ngrams(points, n) for n in language_id.ORDERS]))
    texts = ["abcd efgh " * 50 + "xyz", "zyx " * 3, "", "..", "a" + "." * 90 + "b"]
    whole = language_id.classifier(filters)(texts)
    for piece in (1, 2, 3, 4, 37):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert language_id.classifier(filters)(texts) == whole


def brute_language(texts_by_lang, text, top):
    """The share of a text's n-grams that are among the commonest of each language, by plain sets."""
    def grams(t):
        run = [0]
        for c in t.lower():
            if c.isalpha():
                run.append(c)
            elif run[-1] != 0:
                run.append(0)
        run += [0] if run == [0] or run[-1] != 0 else [0]
        return [tuple(run[i : i + n]) for n in (2, 3, 4) for i in range(len(run) - n + 1)]

    shares = {}
    for lang, own in texts_by_lang.items():
        seen = Counter(g for t in own for g in set(grams(t)))
        best = set(sorted(seen, key=lambda g: -seen[g])[:top])
        asked = grams(text)
        shares[lang] = sum(g in best for g in asked) / max(1, len(asked))
    return shares


def test_languages_by_brute_force(spark):
    """With filters that hold every n-gram, counts corrected for chance are the counts of plain sets."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").limit(60)
    rows = docs.collect()
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r["text"])
    filters = language_id.fit(spark.createDataFrame(rows, docs.schema), per_language=10**9, top=10**9)
    filters_wide = language_id.Filters(filters.languages, bits=24)
    letters = language_id.Letters()
    for i, lang in enumerate(filters_wide.languages):
        for t in by[lang]:
            for points, begun in letters.pieces(t):
                filters_wide.add(i, np.concatenate([language_id.ngrams(points, n)[:begun] for n in language_id.ORDERS]))
    asked = [r["text"] for r in rows[:12]] + ["quux the zyx", "ein und das", "1 2 3"]
    langs, scores = language_id.classifier(filters_wide)(asked)
    for text, lang, score in zip(asked, langs, scores, strict=True):
        want = brute_language(by, text, 10**9)
        if any(c.isalpha() for c in text):
            assert score == pytest.approx(max(want.values()), abs=0.02) and want[lang] >= max(want.values()) - 0.02
        else:
            assert (lang, score) == ("und", 0)


def test_too_many_languages_are_an_error(spark):
    rows = spark.createDataFrame([(i, "x", f"l{i}") for i in range(5)], "doc_id int, text string, lang string")
    with pytest.raises(ValueError, match="more than 4"):
        language_id.fit(rows, most_languages=4)
    assert len(language_id.fit(rows, most_languages=5).languages) == 5


def test_wand_finds_what_all_scores_show():
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(3, 150)))) for i in range(120)]
    index = decontamination.Index(items)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, min(100, len(index.terms)))))
        threshold = rng.choice([0.05, 0.1, 0.3, 0.6])
        scores = defaultdict(float)
        for t in terms:
            for u, x in zip(*index.postings(t)[:2], strict=True):
                scores[u] += x
        assert {u for u, _ in index.search(terms, threshold)} == {u for u, s in scores.items() if s >= threshold - 1e-9}
        hopeful = index.hopeful(np.zeros(len(terms), np.int64), np.array(terms), 1, threshold)[0]
        assert hopeful or not any(s >= threshold for s in scores.values())


def leaks(docs, items):
    return {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, items).collect()}


def test_planted_items_are_found_and_others_are_not(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, sentence(rng.randint(8, 100)) + " " + sentence(rng.randint(1, 20))) for i in range(60)]
    rows, planted = [], set()
    for d in range(80):
        parts = [sentence(12) for _ in range(rng.randint(0, 40))]
        if d % 3 == 0:
            i = rng.randrange(60)
            parts.insert(rng.randint(0, len(parts)), items[i][1] if d % 2 else items[i][1].upper().replace(".", " !"))
            planted.add((d, i))
        elif d % 3 == 1:  # the question without its answer is no leak
            parts.insert(0, items[rng.randrange(60)][1].split(". ")[0][: 40])
        rows.append((d, " ".join(parts)))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leaks(docs, bench) == planted
    clean = decontamination.decontaminated(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in planted}
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 4000)
    assert leaks(docs, bench) == planted
    assert {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in planted}


def test_decontamination_of_odd_tables(spark, docs, none):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog. Encore une fois!"), (None, "the quick brown fox jumps over the lazy dog encore une fois"), (2, None), (3, ""), (4, "...")], "item_id bigint, text string")
    assert leaks(docs, bench) == {(4, 1), (4, None)}
    assert decontamination.decontaminated(docs, bench).count() == docs.count() - 1
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).count() == 0
    named = decontamination.contamination(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), bench.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text"))
    assert sorted(map(tuple, named.select("doc_id", "item_id").collect()), key=repr) == [("4", "i1"), ("4", None)]
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == docs.count()


def test_short_items_and_edited_copies(spark):
    item = "Who was the second person to walk upon the cold grey surface of the moon that year? It was the pilot Buzz Aldrin, not Collins."
    short = [(1, "yes"), (2, "Yes. No."), (3, "one two three four")]
    bench = spark.createDataFrame([*short, (9, item), (9, item), (10, item)], "item_id bigint, text string")
    around = " ".join(f"w{i}" for i in range(200))
    texts = [
        "I said yes to it. No, one two three four!",
        f"{around} {item} {around}",
        f"{around} {item.replace('cold', 'bare')} {around}",  # a word of the question
        f"{around} {item.replace('pilot', 'captain')} {around}",  # a word of the answer
        f"{around} {item.replace('Buzz Aldrin, not Collins', 'nobody else at all then')} {around}",
        f"{item.split('?')[0]}? {around}",
        f"{around} It was the pilot Buzz Aldrin, not Collins. {around}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r[:2] for r in map(tuple, decontamination.contamination(docs, bench).collect())) == sorted((d, i) for d in (1, 2, 3) for i in (9, 9, 10))
    assert {r["doc_id"] for r in decontamination.decontaminated(docs, bench).collect()} == {0, 4, 5, 6}


def test_words_in_order():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice(b"abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination._in_order(a, b) == best[-1][-1]


def test_units_are_of_like_length():
    for n in (1, 63, 64, 65, 129, 1000):
        words = [b"%d" % i for i in range(n)]
        units = decontamination.units_of(words)
        assert [w for u in units for w in u] == words and max(map(len, units)) <= 64 and max(map(len, units)) - min(map(len, units)) <= 1


def test_media_round_trip(docs, none, spark):
    out = media.with_media(docs).select("doc_id", "text", "media", media.samples("media").alias("payload"), media.probe("media").alias("info")).collect()
    for r in out:
        payload = media.padded((r["text"] or "").encode())
        assert bytes(r["payload"]) == payload and len(payload) % 64 == 0 and payload
        info = r["info"]
        assert (info["codec"], info["n_samples"], info["error"]) == ("raw ", len(payload) // 64, None)
        assert info["duration_ms"] == len(payload) // 64 * 1000 // 25
        for n, k in enumerate(info["keyframes"]):
            assert bytes(r["media"])[k["start"] : k["end"]] == payload[n * 16 * 64 : n * 16 * 64 + 64]
    assert media.with_media(none).count() == 0


def test_broken_media_do_not_raise(spark):
    good = media.mux(b"x" * 300)
    rng = random.Random(0)
    bad = [None, b"", b"junk", good[:200], good[: len(good) - 10], good.replace(b"stsc", b"free")]
    bad += [bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in good) for _ in range(50)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, media binary")
    got = rows.select("i", media.probe("media").alias("p"), media.samples("media")).orderBy("i").collect()
    assert all(r["p"]["codec"] is None and r["p"]["error"] and r[2] is None for r in got[:6])


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def u32(*numbers):
    return b"".join(n.to_bytes(4, "big") for n in numbers)


def test_counts_and_depth_are_bounded():
    """Counts far beyond the file, and boxes nested 5,000 deep, are errors or nothing, and cost little."""
    good = media.mux(bytes(range(256)) * 4)
    for kind in (b"stsz", b"stts", b"stsc", b"stco", b"stss"):
        at = good.index(kind) + 4
        for field in range(4, 20, 4):
            for value in (0, 1, 0x7FFFFFFF, 0xFFFFFFFF):
                bad = good[: at + field] + u32(value) + good[at + field + 4 :]
                got = media._probed(bad)
                assert got["error"] or got["n_samples"] <= len(bad)
    deep = b""
    for _ in range(5000):
        deep = box(b"moov", deep)
    assert media._probed(deep)["error"] == "no track"
    rng = random.Random(1)
    for _ in range(2000):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(bad) - 4)
            bad[at : at + 4] = rng.choice([u32(0), u32(0xFFFFFFFF), u32(rng.getrandbits(32)), b"moof", b"trun", b"trak", b"tfhd"])
        media._probed(bytes(bad))


def fragmented(payloads, audio_first=True):
    """A file with an audio track without samples, a video track, and a fragment for each payload."""
    def trak(number, kind, codec, extra):
        entry = box(codec, bytes(6) + b"\0\1" + extra)
        empty = [box(k, u32(0, 0)) for k in (b"stts", b"stsc", b"stco")]
        stbl = box(b"stbl", box(b"stsd", u32(0, 1), entry), *empty, box(b"stsz", u32(0, 0, 0)))
        return box(b"trak", box(b"tkhd", u32(0, 0, 0, number, 0)), box(b"mdia", box(b"mdhd", u32(0, 0, 0, 1000, 0, 0)), box(b"hdlr", u32(0, 0), kind, bytes(13)), box(b"minf", stbl)))

    sound, sight = trak(1, b"soun", b"mp4a", bytes(8) + b"\0\2\0\x10" + bytes(8)), trak(2, b"vide", b"avc1", bytes(16) + b"\0\x20\0\x10" + bytes(50))
    trex = box(b"mvex", *(box(b"trex", u32(0, i, 1, 20, 5, 0x10000)) for i in (1, 2)))
    out = box(b"ftyp", b"isom") + box(b"moov", *([sound, sight] if audio_first else [sight, sound]), trex)
    want, keys = [], []
    for sizes, data in payloads:
        sound_run = box(b"trun", u32(0x1, 1, 0))  # one sample of the default size
        sight_run = box(b"trun", u32(0x1 | 0x4 | 0x200, len(sizes), 0, 0), u32(*sizes))  # the first one is a keyframe
        def moof(a, b):
            first = box(b"traf", box(b"tfhd", u32(0x20000, 1)), sound_run.replace(u32(0x1, 1, 0), u32(0x1, 1, a)))
            then = box(b"traf", box(b"tfhd", u32(0x20008, 2, 40)), sight_run.replace(u32(len(sizes), 0, 0), u32(len(sizes), b, 0)))
            return box(b"moof", box(b"mfhd", u32(0, 1)), first, then)
        size = len(moof(0, 0))
        at = len(out)
        out += moof(size + 8, size + 8 + 5) + box(b"mdat", b"sound" + data)
        begin = at + size + 8 + 5
        want.append((begin, begin + len(data)))
        keys.append((begin, begin + sizes[0]))
    return out, want, keys


@pytest.mark.parametrize("audio_first", [True, False])
def test_fragments_and_several_tracks(audio_first):
    data, want, keys = fragmented([([3, 4], b"abcdefg"), ([2, 2, 5], b"123456789")], audio_first)
    found = media.tracks(data)
    video = media.first_track(found)
    assert (video.kind, video.codec, video.width, video.height) == ("vide", "avc1", 32, 16)
    assert video.ranges() == want and video.ticks == 5 * 40
    got = media._probed(data)
    assert [(k["start"], k["end"]) for k in got["keyframes"]] == keys and got["n_samples"] == 5 and got["duration_ms"] == 200
    sound = got["tracks"][0 if audio_first else 1]
    assert (sound["kind"], sound["codec"], sound["width"], sound["n_samples"], sound["duration_ms"], sound["keyframes"]) == ("soun", "mp4a", None, 2, 40, [])
    assert b"".join(data[a:b] for a, b in video.ranges()) == b"abcdefg123456789"


def test_wide_boxes_and_several_chunks():
    data = media.mux(bytes(range(256)) * 40)
    (track,) = media.tracks(data)
    assert len(track.ranges()) == 1 and track.sizes.sum() == 10240
    at = data.index(b"mdat") - 4
    wide = data[:at] + (1).to_bytes(4, "big") + b"mdat" + (16 + 10240).to_bytes(8, "big") + data[at + 8 :]
    kinds = [k for k, _, _ in media.boxes(memoryview(wide), 0, len(wide))]
    assert kinds == [b"ftyp", b"moov", b"mdat"]


@pytest.mark.parametrize("n", [0, 1, 30, 3000])
def test_cutting_stock(n):
    rng = np.random.default_rng(n)
    sizes, demands = np.unique(rng.integers(1, 60, n), return_counts=True)
    patterns, counts, left = cutting_stock.whole_patterns(sizes, demands, 64)
    assert (left >= 0).all() and (counts @ patterns + left == demands).all() if n else not len(counts)
    if n:
        assert (patterns @ sizes <= 64).all()
        assert left @ sizes <= 64 * len(sizes)
    if n == 3000:
        _, amounts = cutting_stock.relaxed(sizes, demands, 64)
        assert amounts.sum() >= demands @ sizes / 64 - 1e-6
        assert counts.sum() + left @ sizes / 64 <= 1.02 * amounts.sum() + 1


def packed_checks(tokens, pieces):
    ids = {r["row"]: np.frombuffer(r["ids"], "<u4") for r in tokens.collect()}
    by, seqs = defaultdict(list), defaultdict(list)
    for p in pieces.collect():
        by[p["row"]].append(p)
        seqs[p["sequence_id"]].append(p)
    assert by.keys() == ids.keys()
    for row, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[row])
            assert p["ids_crc32"] == zlib.crc32(ids[row][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[row])
    padding = total = 0
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        total += at
        padding += 4096 - at if at & (at - 1) else 0
    return padding / max(1, total)


def test_packing(spark, docs, none):
    tokens = packing.tokenized(docs, packing.default_tokenizer())
    pieces = packing.packed(tokens)
    assert packed_checks(tokens, pieces) < 0.05
    found = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(pieces, tokens).collect()}
    assert sum(map(len, found.values())) == 4 * sum(r["n"] for r in tokens.collect())
    assert packing.packed(packing.tokenized(none, packing.default_tokenizer())).count() == 0
    whole = table(spark, "/root/testdata/sf0.001", "documents")
    tokens = packing.tokenized(whole, packing.default_tokenizer())
    assert packed_checks(tokens, packing.packed(tokens)) < 0.03


def test_sharding(spark, docs, none, tmp_path):
    out = sharding.sharded(docs, shards=3, bucket_bytes=20_000)
    assert out.columns == [*docs.columns, "__shard", "__slot"]
    rows = out.collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    sizes = Counter(r["__shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["__slot"] for r in rows if r["__shard"] == s) == list(range(n))
    assert sharding.sharded(none).count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("__shard").count().count() == 3


def test_sharding_repeats_itself_and_mixes(spark):
    docs = spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = (sorted((r["doc_id"], r["__shard"], r["__slot"]) for r in sharding.sharded(docs).collect()) for _ in range(2))
    assert one == two
    ranks = np.array([s * 250 + t for _, s, t in one])
    assert abs(np.corrcoef(np.arange(2000), ranks)[0, 1]) < 0.1
    assert sorted(sharding.fisher_yates(50, 1)) == list(range(50))


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Encore une fois the quick brown fox. Jumps over it!")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        out = start
        for name, stage in corpus_pipeline.STAGES:
            before, out = out, stage(spark, out, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                assert out.count() <= before.count()
        assert (out.count() > 0) == (start is docs)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
