"""Numbers, dates, codes and arrays. All are Column -> Column; what can't be read is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short codes of names, as exported.
AUTHOR_POSITIONS = {"first": "f", "middle": "m", "last": "l"}
INSTITUTION_TYPES = {"education": "e", "healthcare": "h", "company": "c", "archive": "a", "nonprofit": "n", "government": "g", "facility": "f", "other": "o"}
SOURCE_TYPES = {"journal": "j", "repository": "r", "conference": "c", "ebook platform": "e", "book series": "b", "metadata": "m", "other": "o"}


def number(value: Column) -> Column:
    """With commas between thousands."""
    return F.nullif(F.trim(F.translate(value, ",", "")), F.lit("")).try_cast("double")


def decimal_comma_number(value: Column) -> Column:
    """With points between thousands and a decimal comma."""
    return F.nullif(F.trim(F.replace(F.translate(value, ".", ""), F.lit(","), F.lit("."))), F.lit("")).try_cast("double")


def finite(value: Column) -> Column:
    """A number; blank, NA, NaN and infinities are null."""
    x = F.trim(value).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def whole(value: Column) -> Column:
    """Truncated to an integer."""
    x = F.trim(value).try_cast("double")
    return F.when(~F.isnan(x), x).try_cast("bigint")


def is_zero(value: Column) -> Column:
    """Blank is not zero."""
    return F.coalesce(F.trim(value).try_cast("double") == 0, F.lit(False))


def is_one(value: Column) -> Column:
    return F.coalesce(F.trim(value).try_cast("double") == 1, F.lit(False))


def iso_date(value: Column) -> Column:
    """A date, or the first ten characters of a longer form."""
    return F.try_to_date(F.substring(F.trim(value), 1, 10), "yyyy-MM-dd")


def year_of(year: Column, date: Column) -> Column:
    """The year if it is one, else the first four characters of the date."""
    return F.coalesce(F.trim(year).try_cast("int"), F.substring(date, 1, 4).try_cast("int"))


def code(value: Column, codes: dict[str, str], absent: str | None = "") -> Column:
    """The short code of a name in any case; other names stay, null is `absent`."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(value)), value, F.lit(absent))


def blanks_for_nulls(values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")))


def any_prefix(values: Column, prefix: str) -> Column:
    """Whether an element starts with prefix, in any case."""
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.startswith(F.lower(v), F.lit(prefix)))


#: Right-closed edges of the citation percentile bins.
BIN_EDGES = (0.50, 0.75, 0.90, 0.95, 0.99)


def citation_bin(percentile: Column) -> Column:
    out = F.when(percentile <= BIN_EDGES[0], 0)
    for i, edge in enumerate(BIN_EDGES[1:], 1):
        out = out.when(percentile <= edge, i)
    return F.when(percentile.isNotNull(), out.otherwise(len(BIN_EDGES)))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounds the exact value of a double, ties to even; F.round takes the shortest decimal that reads as the
    double, and ties away from zero. The product with 10**digits is formed with its rounding error."""
    scale = float(10**digits)
    parts = let(value.cast("double"), lambda x: let(x * 134217729.0, lambda c: F.struct(x.alias("x"), (c - (c - x)).alias("high"))))
    with_error = let(parts, lambda p: let(p["x"] * scale, lambda q: F.struct(p["x"].alias("x"), q.alias("q"), ((p["high"] * scale - q) + (p["x"] - p["high"]) * scale).alias("e"))))

    def rounded(p: Column) -> Column:
        low = F.floor(p["q"]).cast("double")
        over = (p["q"] - low - 0.5) + p["e"]
        whole = low + F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.abs(low % 2))
        return F.when(F.abs(p["q"]) < float(1 << 51), whole / scale).otherwise(p["x"])

    return let(with_error, rounded)


def jittered(value: Column, key: Column, seed: int, spread: float) -> Column:
    """value times a number from 1 - spread to 1 + spread, which key and seed decide."""
    unit = F.shiftrightunsigned(splitmix64(key.cast("bigint").bitwiseXOR(F.lit(seed).cast("bigint"))), 11).cast("double") / float(1 << 53)
    return value * (1 + spread * (2 * unit - 1))


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


_LOW = (1 << 32) - 1


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**64, of bit patterns: products of 32 by 16 bits never overflow."""
    high, low = factor >> 32, factor & _LOW

    def product(p: Column) -> Column:
        # p.a, p.b: low 32 bits as halves of 16; p.h: high 32 bits
        cross = (p["a"] * high).bitwiseAND(F.lit(_LOW)) + F.shiftleft((p["b"] * high).bitwiseAND(F.lit(0xFFFF)), 16)
        own = F.shiftleft((F.shiftright(p["h"], 16) * low).bitwiseAND(F.lit(0xFFFF)), 16) + (p["h"].bitwiseAND(F.lit(0xFFFF)) * low).bitwiseAND(F.lit(_LOW))
        first = p["a"] * low + F.shiftleft((p["b"] * low).bitwiseAND(F.lit(0xFFFF)), 16)
        top = F.shiftright(p["b"] * low, 16) + F.shiftright(first, 32) + cross + own
        return F.shiftleft(top.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(first.bitwiseAND(F.lit(_LOW)))

    halves = lambda v: F.struct(v.bitwiseAND(F.lit(0xFFFF)).alias("a"), F.shiftrightunsigned(v, 16).bitwiseAND(F.lit(0xFFFF)).alias("b"), F.shiftrightunsigned(v, 32).alias("h"))
    return let(x, lambda v: let(halves(v), product))


def _plus(x: Column, n: int) -> Column:
    """x + n modulo 2**64, of bit patterns."""
    high, low = n >> 32, n & _LOW
    return let(x, lambda v: let(v.bitwiseAND(F.lit(_LOW)) + low, lambda s: F.shiftleft((F.shiftrightunsigned(v, 32) + high + F.shiftright(s, 32)).bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(s.bitwiseAND(F.lit(_LOW)))))


def splitmix64(x: Column) -> Column:
    """The SplitMix64 mixer, as the bit pattern of an unsigned number."""
    shifted = lambda v, n: let(v, lambda y: y.bitwiseXOR(F.shiftrightunsigned(y, n)))
    x = _plus(x.cast("bigint"), 0x9E3779B97F4A7C15)
    x = _times(shifted(x, 30), 0xBF58476D1CE4E5B9)
    x = _times(shifted(x, 27), 0x94D049BB133111EB)
    return shifted(x, 31)


def unsigned_order(x: Column) -> Column:
    """Sorts bit patterns as unsigned numbers."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def output_property(base: str, damping: float | None = None, lag: int | None = None) -> str:
    """base without a trailing _lag<n>, then the lag and the damping if they are given."""
    out = re.sub(r"_lag\d+\Z", "", base)
    out += "" if lag is None else f"_lag{lag}"
    return out if damping is None else f"{out}_{damping:.2f}"
