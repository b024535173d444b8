"""Assembling released tables: joins of all parts on the source, in the released order."""

from __future__ import annotations

import json
import lzma
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.storage import write_atomically


def in_order(rows: DataFrame, released: DataFrame, key: str, own: str) -> DataFrame:
    """rows with place, from 1: the released `ord` first, unknown keys last in their own order."""
    known = rows.join(released.select(key, F.col("ord").alias("__ord")), key, "left")
    return known.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("__ord", F.lit(2147483647)), own))).drop("__ord")


def assembled(base: DataFrame, parts: dict[str, DataFrame], key: str = "source_id") -> DataFrame:
    """base with the columns of each part, named <part>_<column>; what a part lacks is 0."""

    def add(out: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, part = item
        renamed = part.select(key, *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != key])
        return out.join(renamed, key, "left").fillna(0, [c for c in renamed.columns if c != key])

    return reduce(add, parts.items(), base)


def per_work(total: Column, works: Column) -> Column:
    """The rounded total over the works, 0 without works."""
    return F.when(works > 0, F.round(total, 6) / F.nullif(works, F.lit(0))).otherwise(0.0)


def share(part: Column, works: Column) -> Column:
    """Blank without works."""
    return part / F.nullif(works, F.lit(0))


def write_records(df: DataFrame, path: str) -> None:
    """A released file: one xz-compressed JSON array in the order of the rows, in whatever store the path is
    in, under another name until it is whole. It goes through the driver row by row, as such a file has to;
    tables of any size are written with df.write instead."""
    packed = lzma.LZMACompressor()
    out = [packed.compress(b"[")]
    for i, row in enumerate(df.toLocalIterator()):
        out.append(packed.compress((("," if i else "") + "\n" + json.dumps(row.asDict(True), ensure_ascii=False)).encode()))
    write_atomically(df.sparkSession, path, b"".join([*out, packed.compress(b"\n]\n"), packed.flush()]))
