"""Ids of texts by a tokenizer file, by arrays where that is sure to give the tokenizer's own ids.

Where the file says that a text is normalised and split as WORD_RULES say, no token goes across white
space. Then the texts are taken as bytes: arrays find the units (a word's letters, a digit, a run of
marks, a contraction), units are told apart by 128 bits of hash, and each distinct one is encoded
once (see bpe). A word with anything but printed ASCII and Latin-1 letters is a unit as it is, which
the tokenizer itself encodes. Any other file, and one whose probe texts come out differently, encodes
whole texts by the tokenizer.

What is remembered between texts is bounded by MEMO_UNITS and ends with the task.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np

from citegrain.llm.bpe import BytePairs, ragged
from citegrain.llm.common import WordKernel

END_ID = 2
#: Units whose ids a task remembers, some 40 bytes each; those that are merged in at once; bytes of
#: text that the arrays take at once.
MEMO_UNITS, RECENT_UNITS, PIECE_BYTES = 600_000, 60_000, 1 << 19
#: How a tokenizer normalises and splits a text that may be taken in units.
WORD_RULES = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
_PROBES = (
    "It's 2024: THE naïve Straße, über-große façade (cf. [12] {x_y}) don't \"we've\"\tstop?!\n\nÁ été — €5 ﬁn",
    "<|endoftext|> a<|startoftext|>b <|no|> '' ''s 's'll ...'re 100.000,00 http://a.example/x?y=1&z=%20 你好 рус \U0001f600‍\U0001f600",
    " ".join(f"{a}{b}{c}ing" for a in "bcdstéü" for b in "aeiouäö" for c in "lmnrstz"),
    "",
)
_LETTER, _DIGIT, _MARK, _ODD = 1, 2, 3, 4
_APOSTROPHE = ord("'")


def _classes() -> np.ndarray:
    """The class of each byte; 0 is white space. Bytes beyond ASCII are odd until they prove to be letters."""
    out = np.full(256, _ODD, np.int8)
    out[0x21:0x7F] = _MARK
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = _LETTER
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


class Memo:
    """Ids of units: sorted hashes, and ranges of one array of ids."""

    def __init__(self) -> None:
        self.ids = np.zeros(0, np.uint32)
        #: columns: second hash, start and count in ids; the latest additions are apart
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((3, 0), np.uint64)
        self.new_keys, self.new_rows = self.keys, self.rows

    @staticmethod
    def _found(keys: np.ndarray, rows: np.ndarray, asked: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return (keys[at] == asked) & (rows[0][at] == check), at

    def find(self, asked: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, starts, counts) of hashes."""
        starts, counts, known = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        for keys, rows in ((self.keys, self.rows), (self.new_keys, self.new_rows)):
            hit, at = self._found(keys, rows, asked, check)
            starts[hit], counts[hit] = rows[1][at[hit]], rows[2][at[hit]]
            known |= hit
        return known, starts, counts

    def add(self, keys: np.ndarray, check: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The starts of the ids of sorted new keys."""
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids])
        self.new_keys, self.new_rows = _merged(self.new_keys, self.new_rows, keys, np.stack([check, starts.astype(np.uint64), counts.astype(np.uint64)]))
        return starts

    def settle(self) -> None:
        """Keeps the bounds."""
        if len(self.new_keys) > RECENT_UNITS:
            if len(self.keys) + len(self.new_keys) > MEMO_UNITS:  # the latest stay, and common units come back soon
                starts, counts = self.new_rows[1].astype(np.int64), self.new_rows[2].astype(np.int64)
                self.ids = self.ids[ragged(starts, counts)]
                self.new_rows[1] = (np.cumsum(counts) - counts).astype(np.uint64)
                self.keys, self.rows = self.new_keys, self.new_rows
            else:
                self.keys, self.rows = _merged(self.keys, self.rows, self.new_keys, self.new_rows)
            self.new_keys, self.new_rows = np.zeros(0, np.uint64), np.zeros((3, 0), np.uint64)


def _merged(keys: np.ndarray, rows: np.ndarray, more: np.ndarray, more_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(rows, at, more_rows, axis=1)


class Tokens:
    """Ids of texts by one tokenizer file. `arrays` says whether units are used."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.arrays = Tokenizer.from_file(path), False
        spec = json.loads(self.tokenizer.to_str())
        added = spec["added_tokens"]
        parts = all(t["special"] and not t["normalized"] and t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) for t in added)
        rules = tuple((spec[k] or {}).get(name) for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if rules == WORD_RULES and added and parts and spec["model"]["type"] == "BPE":
            try:
                self.pairs = BytePairs(spec["model"])
            except (KeyError, ValueError):
                return
            self.mark, self.mark_id = added[-1]["content"], added[-1]["id"]
            self.one, self.two, self.classes = WordKernel(), WordKernel(0xD6E8FEB86659FD93), _classes()
            self.arrays = True
            self.arrays = self(list(_PROBES)) == [self._encoded(t) for t in _PROBES]

    @classmethod
    def of(cls, path: str) -> Tokens:
        """One for each file and worker: its size depends on the file alone."""
        kept = sys.modules.setdefault("_citegrain_tokens", ModuleType("_citegrain_tokens")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def __call__(self, texts: list[str], memo: Memo | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end token last."""
        if not self.arrays:
            return [self._encoded(t) for t in texts]
        memo = memo or Memo()
        return _joined(self._ids(data, ends, memo) for data, ends in _pieces(texts))

    def _ids(self, data: np.ndarray, ends: np.ndarray, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids up to each end)."""
        data, starts, stops, odd = self._units(data)
        h1, h2 = self.one.hashes(data, starts, stops), self.two.hashes(data, starts, stops)
        keys, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
        check = h2[first]
        if (check[inverse] != h2).any():  # equal in 64 bits of hash only: told apart by all of them
            both = np.stack([h1, h2], axis=1)
            _, first, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
            inverse, keys, check = inverse.reshape(-1), h1[first], h2[first]
            found, counts = self._encode(data, starts[first], stops[first], odd[first])
            at, pool = np.cumsum(counts) - counts, found
        else:
            known, at, counts = memo.find(keys, check)
            new = np.flatnonzero(~known)
            if len(new):
                found, own = self._encode(data, starts[first[new]], stops[first[new]], odd[first[new]])
                at[new], counts[new] = memo.add(keys[new], check[new], found, own), own
            pool = memo.ids
        each = counts[inverse]
        ids = pool[ragged(at[inverse], each)]
        if pool is memo.ids:
            memo.settle()
        sums = np.concatenate(([0], np.cumsum(each)))
        return ids, sums[np.searchsorted(starts, ends)]

    def _units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in lower case, starts, ends, whether odd) of the units. data ends in white space."""
        kinds = self.classes[data]
        # two bytes of a Latin-1 letter: C3 and 80 to BF but 97 and B7
        lead = np.flatnonzero(data[:-1] == 0xC3)
        then = data[lead + 1]
        lead = lead[(then >= 0x80) & (then <= 0xBF) & (then != 0x97) & (then != 0xB7)]
        kinds[lead] = kinds[lead + 1] = _LETTER
        solid = np.zeros(len(data) + 1, bool)
        solid[1:] = kinds != 0
        lower = data.copy()
        upper = (data >= ord("A")) & (data <= ord("Z"))
        upper[lead + 1] = data[lead + 1] <= 0x9E
        lower[upper] += 32
        start = (kinds != 0) & (np.concatenate(([0], kinds[:-1])) != kinds)
        start |= kinds == _DIGIT
        self._contractions(lower, kinds, start)
        # words with an odd byte or <| stay whole, in their own case
        odd = np.flatnonzero(kinds == _ODD)
        tags = np.flatnonzero(data[:-1] == ord("<"))
        odd = np.concatenate([odd, tags[data[tags + 1] == ord("|")]])
        inside = np.zeros(len(data) + 1, np.int8)
        if len(odd):
            begins, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~np.append(solid[1:-1], False) & (np.arange(len(data)) > 0))
            own = np.unique(np.searchsorted(begins, odd, side="right") - 1)
            inside[begins[own]] += 1
            inside[ends[own]] -= 1
            inside = np.cumsum(inside, dtype=np.int8)
            whole = inside[:-1] > 0
            start &= ~whole
            start[begins[own]] = True
            lower[whole] = data[whole]
        starts = np.flatnonzero(start)
        stops = np.flatnonzero(solid[1:] & np.append(start[1:] | ~solid[2:], True)) + 1
        return lower, starts, stops, inside[starts] > 0

    @staticmethod
    def _contractions(lower: np.ndarray, kinds: np.ndarray, start: np.ndarray) -> None:
        """Joins an apostrophe that stands alone with s, t, m, d, re, ve or ll behind it."""
        at = np.flatnonzero((lower[:-3] == _APOSTROPHE) & start[:-3] & (kinds[1:-2] == _LETTER))
        one, two = lower[at + 1], lower[at + 2]
        single = np.isin(one, list(b"stmd"))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        at, size = np.concatenate([at[single], at[double]]), np.repeat([1, 2], [single.sum(), double.sum()])
        start[at + 1] = False
        start[at + 1 + size] |= kinds[at + 1 + size] == _LETTER

    def _encode(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct units."""
        ids, counts = self.pairs(data, starts[~odd], stops[~odd])
        if not odd.any():
            return ids, counts
        words = [data[a:b].tobytes().decode() for a, b in zip(starts[odd].tolist(), stops[odd].tolist(), strict=True)]
        own = self._parted(words)
        every = np.zeros(len(odd), np.int64)
        every[~odd], every[odd] = counts, [len(x) for x in own]
        out = np.empty(int(every.sum()), np.uint32)
        begun = np.cumsum(every) - every
        out[ragged(begun[~odd], counts)] = ids
        out[ragged(begun[odd], every[odd])] = np.concatenate(own)
        return out, every

    def _parted(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, many given as one text: a special token is taken out of a text before all else,
        so it parts words without an effect on them."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        for k in range(0, len(plain), 1000):
            group = plain[k : k + 1000]
            found = np.frombuffer(self._encoded(self.mark.join(words[i] for i in group)), "<u4")[:-1]
            for i, ids in zip(group, np.split(found, np.flatnonzero(found == self.mark_id)), strict=True):
                out[i] = ids[1:] if len(ids) and ids[0] == self.mark_id else ids
        for i, w in enumerate(words):
            if "<|" in w:
                out[i] = np.frombuffer(self._encoded(w), "<u4")[:-1]
        return out

    def _encoded(self, text: str) -> bytes:
        return np.array([*self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, END_ID], "<u4").tobytes()


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends of texts in them) of runs of texts; three line feeds follow each text. A long text goes
    over several pieces, cut at white space."""
    held, ends, size = [], [], 0

    def piece() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(held) + b"\n\n\n", np.uint8), np.array(ends, np.int64)

    for text in texts:
        raw, at = text.encode(errors="replace") + b"\n", 0
        while len(raw) - at > PIECE_BYTES:
            cut = 1 + min(x for x in (raw.find(b" ", at + PIECE_BYTES), raw.find(b"\n", at + PIECE_BYTES)) if x >= 0)
            held.append(raw[at:cut])
            yield piece()
            held, ends, size, at = [], [], 0, cut
        held.append(raw[at:])
        size += len(raw) - at
        ends.append(size)
        if size >= PIECE_BYTES:
            yield piece()
            held, ends, size = [], [], 0
    if held:
        yield piece()


def _joined(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """The ids of each text, with the end token, from the pieces."""
    out, held, end = [], [], np.array([END_ID], "<u4").tobytes()
    for ids, cuts in found:
        data, before = ids.astype("<u4").tobytes(), 0
        for cut in (cuts * 4).tolist():
            out.append(b"".join([*held, data[before:cut], end]))
            held, before = [], cut
        if before < len(data):
            held.append(data[before:])
    return out
