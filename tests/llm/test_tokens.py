"""Ids by arrays are the tokenizer's own, whatever the text, the tokenizer and the sizes."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from citegrain.llm import packing, tokens
from citegrain.llm.bpe import BytePairs

PARTS = [*"aB'sTllé,.!?|)(<>1 23\n\t\u0301ΣİßǅΩ№ﬁ×÷Ã", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'ll", "\x85", "\xa0", "\x00", "\x1c", "中", "word", "Word,", " ", "don't", "Über-große"]


def texts(n: int = 3000) -> list[str]:
    rng = random.Random(2)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]


def wanted(t: tokens.Tokens, own: list[str]) -> list[bytes]:
    return [np.array([*e.ids, 2], "<u4").tobytes() for e in t.tokenizer.encode_batch(own, add_special_tokens=False)]


@pytest.fixture(scope="module")
def by_arrays():
    found = tokens.Tokens(packing.default_tokenizer())
    assert found.arrays
    return found


def test_arrays_give_the_tokenizers_ids(by_arrays):
    own = texts()
    assert by_arrays(own) == wanted(by_arrays, own)


def test_bounds_have_no_effect(by_arrays, monkeypatch):
    own = texts()
    own[7] = " ".join(own)  # a text of many pieces
    want = wanted(by_arrays, own)
    for name, value in (("MEMO_UNITS", 300), ("RECENT_UNITS", 40), ("PIECE_BYTES", 64)):
        monkeypatch.setattr(tokens, name, value)
    memo = tokens.Memo()
    assert [x for i in range(0, len(own), 100) for x in by_arrays(own[i : i + 100], memo)] == want
    assert len(memo.keys) <= 300 + 400 and len(memo.ids) < 20_000


def test_units_of_equal_hash_are_told_apart(by_arrays, monkeypatch):
    own = texts(200)
    narrow = by_arrays.one.hashes
    monkeypatch.setattr(by_arrays.one, "hashes", lambda *a: narrow(*a) % np.uint64(50))
    assert by_arrays(own) == wanted(by_arrays, own)


@pytest.mark.parametrize("change", [None, "lower", "split"])
def test_other_tokenizers_encode_whole_texts(tmp_path, change):
    """Another file, and files like the default one but for a rule."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    if change:
        spec = json.load(open(packing.default_tokenizer()))
        if change == "lower":
            spec["normalizer"]["normalizers"].pop()
        else:
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"}
        path = str(tmp_path / "other.json")
        json.dump(spec, open(path, "w"))
    other = tokens.Tokens(path)
    assert not other.arrays
    own = texts(300)
    assert other(own) == wanted(other, own)


def test_a_wrong_table_is_noticed(monkeypatch):
    """If the arrays gave other ids than the tokenizer, the probes would show it."""
    monkeypatch.setattr(BytePairs, "_rows", lambda self, data, starts, sizes: (np.zeros(len(starts), np.uint32), np.ones(len(starts), np.int64)))
    assert not tokens.Tokens(packing.default_tokenizer()).arrays
