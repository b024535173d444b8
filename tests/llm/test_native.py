"""Line templates, URL filters and chat formatting."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citegrain.llm import chat_format, line_templates, url_filters

KEPT = ["doc_id", "text", "lang", "source", "n_chars", "k1", "leaf", "row"]


def test_lines_odd_texts(docs, none):
    out = line_templates.drop_recurring_lines(docs, min_docs=2)
    assert out.columns == [*KEPT, "__n_lines", "__n_dropped"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["text"] is None and by[0]["__n_lines"] == 0
    assert by[1]["text"] == "" and by[4]["__n_dropped"] == 0
    assert by[5]["text"] == ""  # held by three rows
    assert by[12]["__n_dropped"] == 0  # repeats in one document only
    assert line_templates.drop_recurring_lines(none).count() == 0


def test_lines_generalise_variable_fields(spark):
    rows = [(i, f"intro number {'abcdefghij'[i]} of its own\nvisited page 12{i} on the 3rd of may\nsigned off by user {'xyz'[i % 3]} in the office today") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    templates = {r["masked"]: r["template"] for r in line_templates.dropped_templates(docs, min_docs=5).collect()}
    assert templates["visited page <*> on the <*> of may"] == "visited page <*> on the <*> of may"
    assert templates["signed off by user x in the office today"] == "signed off by user <*> in the office today"
    out = line_templates.drop_recurring_lines(docs, min_docs=5).collect()
    assert all(r["__n_dropped"] == 2 and r["text"].startswith("intro") for r in out)


def test_unrelated_lines_of_one_leaf_stay(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, "it is one of " + " ".join(words[(i + j * (i + 1)) % 10] + words[i] for j in range(8))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert all(r["__n_dropped"] == 0 for r in line_templates.drop_recurring_lines(docs, min_docs=5).collect())


def test_templates_that_share_a_leaf_are_told_apart(spark):
    """Two templates with one opening and length, a stray line among them; a document that repeats a template
    over and over counts once."""
    name = "ab cd ef gh ij kl mn op".split()
    rows = [(i, f"sent to you by {name[i]} from the north office\nown {name[i]}") for i in range(8)]
    rows += [(20 + i, f"sent to you by post {name[i]} at your usual address"[:99]) for i in range(6)]
    rows += [(40, "sent to you by a quite different line here now"), (41, "\n".join(f"one two three four {x} six seven eight" for x in name)), (42, "one two three four xy six seven eight")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["__n_dropped"] for r in line_templates.drop_recurring_lines(docs, min_docs=5).collect()}
    assert got == {i: 1 for i in range(8)} | {20 + i: 1 for i in range(6)} | {40: 0, 41: 0, 42: 0}


def test_any_number_of_templates_may_share_a_leaf(spark):
    """Seven templates with one opening and length, alike in size and not, are all found; two rounds find none."""
    name, ends = "ab cd ef gh ij kl mn op qr st".split(), "red orange yellow green blue indigo violet".split()
    rows = [(100 * k + i, f"mail sent to you {x} {end} a{end} b{end} c{end}") for k, end in enumerate(ends) for i, x in enumerate(name[: 6 + k % 3])]
    rows += [(900, "mail sent to you by nobody else at all"), (901, "mail sent to you ab other words than the rest")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: r["__n_dropped"] for r in line_templates.drop_recurring_lines(docs, min_docs=5).collect()}
    assert got == {i: int(i < 900) for i, _ in rows}
    assert line_templates.drop_recurring_lines(docs, min_docs=5, rounds=2).where("__n_dropped > 0").isEmpty()


def test_lines_names_that_clash(spark, docs):
    clash = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("__a", "__B", "__gone", "k2", "n", "at", "masked", "lines", "__n_lines"))])
    out = line_templates.drop_recurring_lines(clash, min_docs=2)
    assert out.columns == [*(c for c in clash.columns if c != "__n_lines"), "__n_lines", "__n_dropped"]
    assert out.select("__a", "__B", "__gone", "k2", "n", "at", "masked", "lines").distinct().collect() == [tuple(range(8))]


def test_the_pipeline_drops_recurring_lines_of_one_to_three_tokens(spark):
    rows = [(i, f"Les.\n\nAll rights reserved.\nPage {i}\nonly {'abcdefghijkl'[i]}\n  \nown words {'abcdefghijkl'[i]}") for i in range(12)]
    docs = spark.createDataFrame([*rows, (99, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {99: None} | {i: f"\nonly {'abcdefghijkl'[i]}\n  \nown words {'abcdefghijkl'[i]}" for i in range(12)}


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/a?x#y", "http://a.example.org/en/120", "https://notexample.org/es/", "http://x.com/fr/1", "x://y.com/de/?q", "http://free-bets.io", "http://free-bets.com/fr/", "http://a.org?/x", "http://é.org/é", "a://b://c.org/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate([*URLS, URLS[4]])], "page_id int, url string, __best string, n int")
    rules = url_filters.rules_of(spark, url_filters.SITE_RULES, "block ^bets^")
    out = url_filters.judge_urls(pages, rules)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict", "filter"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["filter"]) for r in out.collect()}
    assert got[0] == got[2] == ("", "", None, "allow", None)
    assert got[4] == got[14] == ("example.org", "/es/a", "example.org/es/", "block", None)
    assert got[5][2:4] == ("example.org/en/1", "block")
    assert got[6][2:4] == ("org/", "allow")
    assert got[7][2:4] == ("com/fr/", "allow")
    assert got[8][2:4] == ("com/de/", "block")
    assert got[9][2:] == (None, "block", "^bets^")
    assert got[10][2:] == ("com/fr/", "allow", None)
    assert got[11] == ("a.org", "", None, "allow", None)
    assert got[12][2] == "org/" and got[13][:2] == ("b:", "//c.org/")
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_patterns_by_brute_force(spark, monkeypatch):
    """Many rules with wildcards and anchors against every URL, also where the rules are joined by shuffle."""
    rng = random.Random(6)
    words = ["ad", "ads", "shop", "x1", "Ab", "é", "news", "a-b", "99"]
    name = lambda k: "".join(rng.choice(words) + rng.choice([".", "/", "-", "_", ""]) for _ in range(rng.randint(1, k)))
    rules = {(rng.choice(["allow", "block"]), rng.choice(["", "|", "||"]) + rng.choice(["", "^", "*", "/"]) + name(3) + rng.choice(["", "*", "^"]) + rng.choice(["", name(2)]) + rng.choice(["", "|", "^|"])) for _ in range(150)}
    rules |= {("block", "*"), ("allow", "|"), ("block", "^^"), ("block", "(.[?+$\\"), ("allow", "a*^*b")}
    urls = ["http://" + name(4) + "/" + name(4) for _ in range(120)] + URLS
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    frame = spark.createDataFrame([("pattern", a, r) for a, r in rules] + [("other", "block", "ads"), ("pattern", "block", None), ("pattern", "block", "")], "kind string, action string, rule string")
    want = {}
    for i, u in enumerate(urls):
        rest = re.match("([^/?#]*)([^?#]*)", u.split("://", 1)[1] if u and "://" in u else "")
        target = "".join(c.lower() if c.isascii() else c for c in rest[1]) + rest[2]
        fits = [(len(r), a == "block", r, a) for a, r in rules if re.search(url_filters.pattern_sql(r).replace(r"\z", r"\Z"), target, re.A)]
        want[i] = max(fits)[2:] if fits else (None, "allow")
    for most in (50_000, 10):
        monkeypatch.setattr(url_filters, "BROADCAST_RULES", most)
        got = {r["page_id"]: (r["filter"], r["verdict"]) for r in url_filters.judge_urls(pages, frame).collect()}
        assert got == want


def test_a_rule_is_filed_under_its_rarest_token(spark):
    rules = url_filters.parsed(url_filters.rules_of(spark, "block example.org/en/1\nallow com/fr/", "block ||ads*.x1^foo|\nallow *y*"))
    tokens = {r["rule"]: sorted(r["tokens"]) for r in rules.collect()}
    # "1", "ads" and "y" are only part of a token of what they match
    assert tokens == {"example.org/en/1": ["en", "example", "org"], "com/fr/": ["com", "fr"], "||ads*.x1^foo|": ["foo", "x1"], "*y*": []}
    seen = spark.createDataFrame([(t,) for t in ["org"] * 3 + ["en"] * 2 + ["example"] * 4 + ["com", "x1"]], "token string")
    assert {r["rule"]: r["token"] for r in url_filters.filed(rules, seen).collect()} == {"example.org/en/1": "en", "com/fr/": "fr", "||ads*.x1^foo|": "foo", "*y*": ""}


def chat(spark, rows):
    return chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int"))


def test_chats_can_be_read_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>[TURN]", "[", "<", "\\", "", None, "a\nb", "[/INST]</s><s>x[INST]", "\U0001f600<s>"]
    rows = [(c, t, ["user", "assistant", "assistant", "sys[INST]tem"][(c + t) % 4], odd[(c * 3 + t) % len(odd)], 0) for c in range(8) for t in range(9)]
    rows += [(9, None, None, None, 0), (9, 1, "assistant", "x", 0), (9, 1, "assistant", "x", 0), (None, 1, "user", "y", 0)]
    got = chat(spark, rows).select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == 10
    for r in got:
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert [(b["role"], b["text"]) for b in r["back"]] == [x[2:] for x in own]
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_adjacent_turns_of_a_role_are_one_block(spark):
    r = chat(spark, [(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, 3, "assistant", "c", 0)]).first()
    assert r["formatted"] == "<s>user[INST]a[TURN]b[/INST]</s><s>assistant[INST]c[/INST]</s>"
    (mask,) = r["loss_mask"]
    assert r["formatted"][mask["start"] : mask["end"]] == "c"
    assert chat(spark, [(1, 1, "user", "a", 0)]).limit(0).count() == 0


@pytest.mark.parametrize("n", [1500])
def test_long_chats(spark, n):
    r = chat(spark, [(1, i, "user" if i % 2 else "assistant", f"t{i}", 0) for i in range(n)])
    loss = r.select(chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("l")).first()["l"]
    assert hashlib.sha256(loss.encode()).digest() == hashlib.sha256("".join(f"t{i}" for i in range(0, n, 2)).encode()).digest()
