"""Byte-pair encoding of very many short words at once, by arrays.

A word is a row of symbols. Each turn finds the pair of lowest rank in every row (the leftmost of
equals) and merges it, in all rows together, until no row has a pair that merges. That is the order
in which byte-pair encoding is defined, so the ids are those of the tokenizer the tables come from.
Pairs are looked up in hash tables, a level for those that collide in the one before.
"""

from __future__ import annotations

import numpy as np

_NONE = np.iinfo(np.int32).max
#: Rows that are worked on at once.
ROWS = 1 << 14


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair of start and count, one after another."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where Latin-1 prints it, else one from 256 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printed else next(others)) for b in range(256)]


class _Ranks:
    """Ranks of pairs of symbols."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        keys, ranks = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), np.arange(len(left), dtype=np.int32)
        self.levels, bits = [], max(4, int(len(keys)).bit_length() + 2)
        factor = 0x9E3779B97F4A7C15
        while len(keys):
            shift, multiplier = np.uint64(64 - bits), np.uint64(factor)
            with np.errstate(over="ignore"):
                at = (keys * multiplier) >> shift
            _, first = np.unique(at, return_index=True)
            slots, values = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, _NONE, np.int32)
            slots[at[first]], values[at[first]] = keys[first], ranks[first]
            self.levels.append((multiplier, shift, slots, values))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            bits, factor = max(4, int(len(keys)).bit_length() + 2), factor + 0x1234567890ABCDEE

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out, todo = np.full(keys.shape, _NONE, np.int32), None
        for multiplier, shift, slots, values in self.levels:
            asked = keys if todo is None else keys[todo]
            at = (asked * multiplier) >> shift
            own = slots[at]
            hit = own == asked
            if todo is None:
                out[hit] = values[at[hit]]
                todo = np.nonzero(~hit & (own != np.uint64(2**64 - 1)))
            else:
                out[tuple(x[hit] for x in todo)] = values[at[hit]]
                left_over = ~hit & (own != np.uint64(2**64 - 1))
                todo = tuple(x[left_over] for x in todo)
            if not len(todo[0]):
                break
        return out


class BytePairs:
    """The ids of words by a model of byte-level symbols: the `model` part of a tokenizer file."""

    def __init__(self, model: dict) -> None:
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain model of byte pairs")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_symbols()], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = _Ranks(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        self.edge = max(vocab.values()) + 1  # a symbol that no pair has

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words data[start:end], which are bytes; a word has at least one."""
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        ids, counts, first = [], np.zeros(len(sizes), np.int64), 0
        while first < len(order):
            # rows of like lengths; a very long word has few beside it
            width = int(sizes[order[min(first + ROWS, len(order)) - 1]])
            end = min(len(order), first + max(1, min(ROWS, ROWS * 64 // width)))
            rows = order[first:end]
            own, counts[rows] = self._rows(data, starts[rows], sizes[rows])
            ids.append(own)
            first = end
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        begun = np.empty(len(order), np.int64)
        begun[order] = np.cumsum(counts[order]) - counts[order]
        return ids[ragged(begun, counts)], counts

    def _rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(starts), int(sizes.max())
        data = data[np.minimum(starts[:, None] + np.arange(width), len(data) - 1)]
        # symbols between two edges; `after` and `before` are the places of a symbol's neighbours
        symbols = np.full((n, width + 2), self.edge, np.int32)
        symbols[:, 1:-1] = np.where(np.arange(width) < sizes[:, None], self.inner[data], self.edge)
        symbols[np.arange(n), sizes] = self.last[data[np.arange(n), sizes - 1]]
        ranks = np.full((n, width + 2), _NONE, np.int32)
        ranks[:, :-1] = self.ranks(symbols[:, :-1], symbols[:, 1:])
        after = np.arange(1, n * (width + 2) + 1)
        before = after - 2
        flat_symbols, flat_ranks = symbols.reshape(-1), ranks.reshape(-1)
        there = symbols != self.edge
        flat_there = there.reshape(-1)
        live = np.arange(n)
        while len(live):
            own = ranks[live]
            best = own.argmin(axis=1)
            rank = own[np.arange(len(live)), best]
            some = rank != _NONE
            live, best, rank = live[some], best[some], rank[some]
            at = live * (width + 2) + best
            gone = after[at]
            next_, prior = after[gone], before[at]
            flat_symbols[at] = self.merged[rank]
            flat_there[gone], flat_ranks[gone] = False, _NONE
            after[at], before[next_] = next_, at
            flat_ranks[at] = self.ranks(flat_symbols[at], flat_symbols[next_])
            flat_ranks[prior] = self.ranks(flat_symbols[prior], flat_symbols[at])
        return flat_symbols[flat_there].astype(np.uint32), there.sum(axis=1)
