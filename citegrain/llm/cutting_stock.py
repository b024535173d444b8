"""Cutting stock by column generation: how to fill stocks of one capacity with pieces of many sizes.

The linear program has a row for each size with its demand and a column for each pattern (how many
pieces of each size go in one stock). It starts from patterns of one size; the duals of its optimum
price new patterns, and a knapsack dynamic program finds the pattern of the highest price. Patterns
are added until none is worth more than `1 + gap`, when the program is within that share of its
optimum. The simplex method keeps the inverse of the basis. Sizes of a histogram bound the program,
however many pieces there are.
"""

from __future__ import annotations

import numpy as np


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack over capacities 0..capacity."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = prices > 1e-12
    kinds, costs, gains = np.flatnonzero(worth), sizes[worth], prices[worth]
    order = np.argsort(costs, kind="stable")
    kinds, costs, gains = kinds[order], costs[order], gains[order]
    fits = np.searchsorted(costs, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := fits[c]:
            total = gains[:k] + value[c - costs[:k]]
            best = int(total.argmax())
            if total[best] > value[c] + 1e-12:
                value[c], pick[c] = total[best], best
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[kinds[pick[c]]] += 1
            c -= int(costs[pick[c]])
    return float(value[capacity]), pattern


def relaxed(sizes: np.ndarray, demands: np.ndarray, capacity: int, gap: float = 2e-3, steps: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, amounts): the linear program's solution, one pattern for each size."""
    n = len(sizes)
    most = np.maximum(1, capacity // sizes)
    patterns = np.diag(most)
    inverse, amounts = np.diag(1.0 / most), demands / most
    for step in range(steps):
        prices = np.clip(inverse.sum(axis=0), 0, None)  # each pattern costs one stock
        value, pattern = best_pattern(prices, sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        usable = direction > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, amounts / np.where(usable, direction, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        amounts = amounts - direction * ratio[out]
        amounts[out] = ratio[out]
        patterns[out] = pattern
        if step % 200 == 199:  # rounding errors
            inverse = np.linalg.inv(patterns.T.astype(float))
            amounts = np.clip(inverse @ demands, 0, None)
    return patterns, amounts


def whole_patterns(sizes: np.ndarray, demands: np.ndarray, capacity: int, gap: float = 2e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, counts, left): whole numbers of stocks of each pattern, and the pieces left over.
    No more pieces are used than there are. Amounts are rounded down; then each pattern, fullest
    first, is used once more while its pieces last."""
    if not len(sizes):
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    patterns, amounts = relaxed(sizes, demands, capacity, gap)
    counts = np.floor(amounts + 1e-9).astype(np.int64)
    left = demands - counts @ patterns
    while (left < 0).any():  # only by a rounding error of the amounts
        bad = int(np.flatnonzero(left < 0)[0])
        users = np.flatnonzero((patterns[:, bad] > 0) & (counts > 0))
        counts[users[0]] -= 1
        left = demands - counts @ patterns
    filled = patterns @ sizes
    for p in np.argsort(-filled, kind="stable"):
        if (patterns[p] <= left).all() and patterns[p].any() and filled[p] >= (1 - 4 * gap) * capacity:
            more = int((left[patterns[p] > 0] // patterns[p][patterns[p] > 0]).min())
            counts[p] += more
            left = left - more * patterns[p]
    # what is left goes in by patterns that the same program finds for what there is of each size
    extra, used = [], []
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.argsort(-sizes, kind="stable"):
            take = min(int(left[k]), room // int(sizes[k]))
            pattern[k] += take
            room -= take * int(sizes[k])
        if room > 4 * gap * capacity:
            break
        more = int((left[pattern > 0] // pattern[pattern > 0]).min())
        extra.append(pattern)
        used.append(more)
        left = left - more * pattern
    if extra:
        patterns, counts = np.vstack([patterns, extra]), np.concatenate([counts, used])
    keep = counts > 0
    return patterns[keep], counts[keep], left
