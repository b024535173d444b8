"""Checks as DataFrames: what breaks a rule is a row, so a rule holds if nothing comes back."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A rule doesn't hold."""


def outside(members: DataFrame, universe: DataFrame, key: str = "id") -> DataFrame:
    """Members that the universe lacks."""
    return members.join(universe.select(key), key, "left_anti")


def compared(expected: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """One row: missing and extra, counted by two anti joins."""
    missing = outside(expected, found, key).agg(F.count("*").alias("missing"))
    return missing.join(F.broadcast(outside(found, expected, key).agg(F.count("*").alias("extra"))))


def exactly(expected: DataFrame, found: DataFrame, key: str = "id") -> None:
    """Raises unless both hold the same keys."""
    r = compared(expected, found, key).first()
    if r["missing"] or r["extra"]:
        raise ContractError(f"{r['missing']} missing, {r['extra']} extra")


def union_members(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("id") for s in sets]).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: only_left and only_right."""
    return compared(a, b, key).select(F.col("missing").alias("only_left"), F.col("extra").alias("only_right"))


def subset_violations(flags: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(rule, violations): rows where the first condition holds and the second doesn't, in one scan."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    counts = flags.agg(*[F.count_if(holds(a) & ~holds(b)).alias(name) for name, a, b in rules])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n, _, _ in rules])))


def membership(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the ids that don't have exactly one row."""
    own = rows.groupBy(key).agg(F.count("*").alias("n"))
    return ids.select(key).distinct().join(own, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def property_counts(rows: DataFrame, name: str) -> DataFrame:
    """One row: how many rows have the property, and where it is true."""
    return rows.agg(F.count(name).alias("present"), F.count_if(F.col(name)).alias("is_true"))


def sparse_patch(rows: DataFrame, ids: DataFrame, name: str, key: str = "id") -> DataFrame:
    """rows with name true for exactly these ids and absent for all others."""
    member = ids.select(F.col(key).alias("__id")).distinct().withColumn("__in", F.lit(True))
    return rows.drop(name).join(member, F.col(key) == F.col("__id"), "left").withColumn(name, F.col("__in")).drop("__id", "__in")


def patched(rows: DataFrame, ids: DataFrame, name: str, key: str = "id", force: bool = False) -> tuple[DataFrame, bool]:
    """(rows, whether anything changed): the sparse patch, left out where rows have the property for exactly
    these ids already unless forced, and verified afterwards."""
    held = rows.where(F.col(name)) if name in rows.columns else rows.limit(0)
    false = rows.where(F.col(name) == False).limit(1).count() if name in rows.columns else 0  # noqa: E712
    known = ids.select(key).distinct()
    difference = compared(known, held.select(key), key).first()
    if not force and not false and not difference["missing"] and not difference["extra"]:
        return rows, False
    out = sparse_patch(rows, known, name, key)
    exactly(known, out.where(F.col(name)).select(key), key)
    if out.where(F.col(name) == False).limit(1).count():  # noqa: E712
        raise ContractError(f"{name} is false somewhere, where it should be absent")
    return out, True


def coverage(expected: DataFrame, found: DataFrame, parts: int, key: str = "id") -> DataFrame:
    """(part, expected, found, missing, extra) of ids dealt out by their remainder: a divided run is whole
    where the last two are 0."""
    both = expected.select(key, F.lit(True).alias("__e")).distinct().join(found.select(key, F.lit(True).alias("__f")).distinct(), key, "full")
    e, f = F.col("__e").isNotNull(), F.col("__f").isNotNull()
    return both.groupBy(F.pmod(F.col(key), F.lit(parts)).alias("part")).agg(F.count_if(e).alias("expected"), F.count_if(f).alias("found"), F.count_if(e & ~f).alias("missing"), F.count_if(f & ~e).alias("extra"))


def partial_failures(summary: DataFrame) -> DataFrame:
    """The rows of a summary of batches (total, committed, failed, errors) that weren't done in full."""
    return summary.where((F.coalesce("failed", F.lit(0)) > 0) | (F.coalesce("committed", F.lit(0)) != F.col("total")) | (F.size("errors") > 0))


def all_done(summary: DataFrame) -> None:
    """Raises if any batch wasn't."""
    if bad := partial_failures(summary).limit(5).collect():
        raise ContractError("; ".join(str(r.asDict()) for r in bad))


def without_results(rows: DataFrame, prefix: str) -> DataFrame:
    """rows without columns of hops and reach counts of a prefix, whatever suffix they have."""
    pattern = re.compile(rf"{re.escape(prefix)}_(min_hops|reachable|reach_count|forward_reach_count)(_test)?(_(w|y|all|[0-9]+|d[0-9]*))*\Z")
    return rows.drop(*[c for c in rows.columns if pattern.match(c)])


def require_columns(rows: DataFrame, *names: str) -> DataFrame:
    if missing := sorted(set(names) - set(rows.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return rows
