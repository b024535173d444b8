"""Ranks, running sums and top-k. A total order is always given, so ties have one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.functions import values
from citegrain.storage import written


def midranks(hist: DataFrame, stratum: list[str], value: str = "cites", n: str = "n") -> DataFrame:
    """midrank of each value in its stratum: (cumulative - n / 2) / total, with the bin it falls in, and
    the cumulative count and total."""
    w = Window.partitionBy(*stratum)
    out = hist.withColumn("cum", F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(n).over(w))
    out = out.withColumn("midrank", (F.col("cum") - F.col(n) * 0.5) / F.col("total"))
    return out.withColumn("bin", values.citation_bin(F.col("midrank")))


def located(rows: DataFrame, ranked: DataFrame, stratum: list[str], value: str = "cites") -> DataFrame:
    """rows with the bin of their value: the frame's own, or, for a value that the frame lacks, that of
    the share of the frame below it. seen tells which. Frame and rows are merged by order within the
    stratum, so there is no join by range."""
    frame = ranked.select(*stratum, value, F.struct(F.col("bin"), F.col("cum"), F.col("total"), F.col(value).alias("at")).alias("__frame"))
    totals = ranked.groupBy(*stratum).agg(F.max("total").alias("__total"))
    keys = rows.select(*stratum, value).distinct().withColumn("__row", F.lit(True))
    both = keys.join(frame, [*stratum, value], "full")
    last = F.last("__frame", ignorenulls=True).over(Window.partitionBy(*stratum).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__last", last).where("__row").join(totals, stratum)
    seen = F.coalesce(F.col("__last.at") == F.col(value), F.lit(False))
    below = F.coalesce(F.col("__last.cum"), F.lit(0)) / F.col("__total")
    found = found.select(*stratum, value, F.when(seen, F.col("__last.bin")).otherwise(values.citation_bin(below)).alias("bin"), seen.alias("seen"))
    return rows.join(found, [*stratum, value])


def average_rank(value: Column, *partition: str) -> Column:
    """Ranks from 1, equals share their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def ordinal(df: DataFrame, metric: str, tie: str, name: str = "rank", partition: tuple[str, ...] = ()) -> DataFrame:
    """1, 2, 3 ... by falling metric, then by the tie column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(metric), F.asc(tie))))


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """1, 2, 3 ... in a total order over all rows, whatever their number: rows are sorted in ranges and
    written, ranges are counted, and a row's place is the rows of the ranges before and its own."""
    first = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    split = F.shiftright("__at", 33)
    counts = first.groupBy(split.alias("__range")).agg(F.count("*").alias("__n"))  # a row for each range
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    out = first.withColumn("__range", split).join(F.broadcast(before), "__range")
    own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, F.col("__before") + own + 1).drop("__at", "__range", "__before")


def paged(df: DataFrame, size: int, key: str) -> DataFrame:
    """df with the page, from 0, that each row is on in the order of its key."""
    return placed(df, F.col(key), name="page").withColumn("page", F.expr(f"(page - 1) div {size}"))


def page_after(df: DataFrame, key: str, last: object, size: int) -> DataFrame:
    """The next rows by key after one."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(size)


def top_k(df: DataFrame, k: int, metric: str, tie: str, *partition: str) -> DataFrame:
    """The k rows with the highest metric, of each group if there are groups."""
    if not partition:
        return df.orderBy(F.desc(metric), F.asc(tie)).limit(k)
    return ordinal(df, metric, tie, "rank", partition).where(F.col("rank") <= k)


def best_by_key(df: DataFrame, key: list[str], metric: str, tie: str) -> DataFrame:
    """The row with the highest metric of each key; one row per key reaches the shuffle from each task."""
    order = F.struct(F.col(metric), -F.col(tie))
    return df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("__best")).select(*key, "__best.*")


def auc(scored: DataFrame, score: str, positive: str, negative: str) -> DataFrame:
    """One row, auc: the chance that a positive scores above a negative, equals counting half. scored has
    counts per score."""
    by = scored.groupBy(score).agg(F.sum(positive).alias("p"), F.sum(negative).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by.select("p", "q", (F.col("p") * (below + F.col("q") / 2)).alias("wins"))
    return wins.agg((F.sum("wins") / F.sum("p") / F.sum("q")).alias("auc"))
