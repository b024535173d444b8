"""What several operators share: tables, broadcasts, joins with hot keys, and word arithmetic on bytes.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR. A text is handled
as UTF-8, in which these six bytes never occur inside another character, so splitting bytes
and splitting characters give the same words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.storage import written

#: Bytes of text that the array kernels take at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of an object together with its classes, so executors need not have this package, as a
    plain broadcast of it would. Only for values of bounded size; received() gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast) -> Any:
    return pickle.loads(broadcast.value)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts share them, so results of a text can be
    joined to every row that holds it, whatever its other columns are."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2")]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each after as many underscores as it takes to be none of df's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key from which it is hot: its rows stay where they are and its value is sent to them; and
#: hot keys up to which that is done. Beyond, Spark splits a hot key's rows while it joins.
HOT_ROWS, HOT_KEYS = 2_000, 200_000


def hot_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str, how: str = "left_semi") -> DataFrame:
    """rows joined (left_semi, inner or left) with keys, which are unique and have the number n of their rows.
    Rows of hot keys aren't shuffled, so no task gets all rows of a key. keys should be a written table. The
    others are joined by sorting, whatever their number, so that plans are alike at every size."""
    own = keys.drop(n).hint("merge")
    hot = keys.where(F.col(n) >= HOT_ROWS).drop(n)
    count = hot.count()
    if not count or count > HOT_KEYS:
        return rows.join(own, on, how)
    near = rows.join(F.broadcast(hot), on, "left_semi" if how == "left_semi" else "inner")
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keys.where(F.col(n) < HOT_ROWS).drop(n).hint("merge"), on, how)
    return near.unionByName(cold)


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, copies, text): a row for each distinct text, written. Equal texts are combined before the
    shuffle, so one that a third of the rows hold is a row a task."""
    keyed = docs.select(*text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text")), "texts")


# --- arrays of bytes -----------------------------------------------------------------------

_SPACES = (9, 10, 11, 12, 13, 32)
_MULTIPLIER = 0x9E3779B97F4A7C15
_MULTIPLIER_2 = 0xC2B2AE3D27D4EB4F


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed. With them a
    polynomial hash of any range of a sequence is a difference of two running sums."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.down[: len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of values[start:end] for each pair; the place of the range has no effect."""
        return mixed((sums[ends] - sums[starts]) * self.up[np.maximum(ends, 1) - 1])


class WordKernel:
    """Splits bytes into words and hashes them without a Python object for each word."""

    def __init__(self, base: int = _MULTIPLIER) -> None:
        self.powers = Powers(base)
        self.solid = np.ones(256, bool)
        self.solid[list(_SPACES)] = False
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER_2))

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marks = np.zeros(len(data) + 2, np.int8)
        marks[1:-1] = self.solid[data]
        edges = np.flatnonzero(np.diff(marks))
        return edges[0::2], edges[1::2]

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.powers.ranges(self.powers.sums(self.values[data]), starts, ends)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about limit bytes. A line feed
    follows each text, so no word goes across two texts. Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        begun = ends[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(ends, begun + limit, side="right")))
        data = "\n".join(texts.slice(row, end - row).to_pylist()).encode() + b"\n"
        yield row, end, data, np.concatenate(([0], ends[row:end] - begun))
        row = end
