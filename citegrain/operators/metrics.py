"""Outside metrics of venues, matched by ISSN, and look-ups in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions import ids

#: Rows of a dimension up to which it is sent to all executors.
SMALL = 200_000


def issn_map(rows: DataFrame, number: Callable[[Column], Column]) -> DataFrame:
    """One row per ISSN: that of rows (ord, issns, metric, ...) with the highest metric, the first of
    equals. issns are parted by commas or semicolons; rows without a metric are ignored."""
    rows = rows.withColumn("metric", number(F.col("metric"))).where(F.col("metric").isNotNull())
    each = rows.withColumn("issn", F.explode(F.split("issns", "[,;]"))).withColumn("issn", ids.issn(F.col("issn"))).where(F.col("issn").isNotNull())
    payload = [c for c in each.columns if c not in ("issn", "issns")]
    best = each.groupBy("issn").agg(F.max_by(F.struct(*payload), F.struct("metric", -F.col("ord"))).alias("best"))
    return best.select("issn", "best.*")


def matched(venues: DataFrame, mapped: DataFrame) -> DataFrame:
    """venues (source_id, issns) with the payload of the ISSN that has the highest metric, the first
    ISSN of equals."""
    each = venues.select("source_id", F.explode_outer(F.array_distinct(F.transform("issns", ids.issn))).alias("issn")).where(F.col("issn").isNotNull())
    payload = [c for c in mapped.columns if c != "issn"]
    found = each.join(mapped, "issn").groupBy("source_id").agg(F.min_by(F.struct(*payload), F.struct(-F.col("metric"), F.col("issn"))).alias("best"))
    return venues.join(found, "source_id", "left").select("source_id", *[F.col(f"best.{c}").alias(c) for c in payload])


def with_names(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows (source_id, name) with source_name: the name, or, where that is missing or blank, the lookup's."""
    return rows.join(lookup, "source_id", "left").select("source_id", F.coalesce(F.nullif("name", F.lit("")), "lookup").alias("source_name"))


def looked_up(rows: DataFrame, key: str, refs: str, table: DataFrame, table_id: str, value: str, name: str) -> DataFrame:
    """rows with the values that an array's references (bare or full ids) have in a table, in place;
    unknown references are blank."""
    one = rows.select(key, F.posexplode(refs).alias("__at", "__ref")).withColumn("__id", ids.bare_id(F.col("__ref")))
    known = table.select(ids.bare_id(F.col(table_id)).alias("__id"), F.col(value).alias("__value"))
    found = one.join(known, "__id", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("__value", F.lit("")).alias("v")))).alias("__all"))
    return rows.join(found, key, "left").withColumn(name, F.transform("__all", lambda x: x["v"])).drop("__all")
