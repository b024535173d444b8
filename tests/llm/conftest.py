import pytest

#: Every case that a text can be: null, empty, blank, short, equal, alike, long, with marks and spaces of all kinds.
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[:60])
TEXTS = [
    None, "", " \t\n", "one", "The quick brown fox jumps over the lazy dog. Encore une fois!", PASSAGE, PASSAGE, "x " + PASSAGE, PASSAGE + " y",
    " ".join(["same"] * 90), "É\u0085à\u2003b\x0bc\rd", "</s>[INST] [TURN] <\\s>", "line one here ok\nline two here ok\n\nline one here ok", " ".join(WORDS) + "\n" + " ".join(WORDS[100:200]),
    "long " * 30_000, "\U0001f600 ok", "a" * 5000,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with odd texts, a repeated row, a null id, and columns whose names clash with inner ones."""
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 1, i, i, i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id at all here", "en", "s", 1, 0, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 bigint, leaf bigint, row bigint")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
