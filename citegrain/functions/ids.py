"""Identifiers: normalisers with deliberately different edge cases. All are Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the prefix of full identifiers.
PREFIX = "https://openalex.org/"


def last_segment(url: Column) -> Column:
    """What follows the last slash; null without one or with nothing behind it."""
    return F.nullif(F.regexp_extract(url, r"/([^/]+)$", 1), F.lit(""))


def bare_id(value: Column) -> Column:
    """Trimmed, without the prefix and then without `works/`."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), "^" + PREFIX.replace(".", r"\."), ""), "^works/", "")


def bare_ids(values: Column) -> Column:
    """bare_id of each element; nulls go."""
    return F.transform(F.filter(values, lambda v: v.isNotNull()), bare_id)


def work_id(value: Column) -> Column:
    """bare_id where that is W and digits, else null."""
    bare = bare_id(value)
    return F.when(bare.rlike(r"^W[0-9]+\z"), bare)


def strict_work_id(value: Column) -> Column:
    """Without the prefix, W and at least one digit, else null; nothing is trimmed."""
    bare = F.regexp_replace(value, "^" + PREFIX.replace(".", r"\."), "")
    return F.when(bare.rlike(r"^W[0-9]+\z"), bare)


def source_id(value: Column) -> Column:
    """Trimmed, without the prefix; blank is null."""
    return F.nullif(F.regexp_replace(F.nullif(F.trim(value), F.lit("")), "^" + PREFIX.replace(".", r"\."), ""), F.lit(""))


def full_id(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit(PREFIX)), value).otherwise(F.concat(F.lit(PREFIX), value))


def field_code(value: Column) -> Column:
    """`22`, `fields/22` and the full form all give `22`: what follows the first slash."""
    bare = F.regexp_replace(value, "^.*?openalex\\.org/", "")
    return F.when(F.contains(bare, F.lit("/")), F.regexp_extract(bare, r"^[^/]*/(.*)$", 1)).otherwise(bare)


def field_number(value: Column) -> Column:
    """The last segment as an int; -1 where absent or no number."""
    return F.coalesce(F.element_at(F.split(value, "/"), -1).try_cast("int"), F.lit(-1))


def issn(value: Column) -> Column:
    """Upper case without hyphens and spaces; null unless eight characters are left."""
    bare = F.trim(F.translate(F.upper(value), "- ", ""))
    return F.when(F.length(bare) == 8, bare)


def id_bucket(value: Column, buckets: int) -> Column:
    """The number behind one letter, modulo buckets; 0 for other ids."""
    return F.when(value.rlike(r"^[A-Za-z][0-9]+\z"), F.substring(value, 2, 30).try_cast("bigint") % buckets).otherwise(F.lit(0))
