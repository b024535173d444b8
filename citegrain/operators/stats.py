"""Statistics that SQL aggregates can give. Every one guards zero variance, which corr() raises on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.operators.windows import average_rank

#: Fixed value: the 97.5 % point of the normal distribution, to six places.
Z = 1.959964


def pearson(x: Column, y: Column) -> Column:
    """The correlation over rows where both are present; null without variance. An aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    n = F.count(a)
    # sums of products of deviations from the mean, which the variance functions form stably
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((n > 1) & (sd > 0), F.covar_pop(a, b) / F.nullif(sd, F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """rho of each group: the correlation of average ranks over rows where both are present."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rows.select(*groups, average_rank(F.col(x), *groups).alias("rx"), average_rank(F.col(y), *groups).alias("ry"))
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), pearson(F.col("rx"), F.col("ry")).alias("rho"))


def fisher(r: Column, n: Column, rank: bool = False) -> tuple[Column, Column]:
    """The 95 % interval of a correlation by Fisher's z; for ranks with Bonett and Wright's error. Null
    below five rows and at |r| = 1."""
    error = F.sqrt((1 + r * r / 2) / (n - 3)) if rank else 1 / F.sqrt(n - 3)
    fits = (n >= 5) & (F.abs(r) < 1)
    z, e = F.when(fits, F.atanh(r)), F.when(fits, error)
    return F.tanh(z - Z * e), F.tanh(z + Z * e)


def flagged(low: Column, high: Column, wide: float = 0.2) -> Column:
    """WIDE for a wide interval, ZERO for one that holds zero, both or blank."""
    return F.concat_ws(" ", F.when(high - low > wide, "WIDE"), F.when((low <= 0) & (high >= 0), "ZERO"))


def grouped_correlations(df: DataFrame, group: str, x: str, y: str, least: int = 5) -> DataFrame:
    """(group, n, r) of groups with enough rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(group).agg(F.count("*").alias("n"), pearson(F.col(x), F.col(y)).alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull())


def between_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row, r2: the share of a value's variance that lies between groups, by two levels of sums."""
    by = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = by.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return total.select((between / F.nullif(between + F.col("w"), F.lit(0.0))).alias("r2"))


def line_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """df with fit, residual and multiplier of a straight line."""
    line = df.agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"))
    fit = F.col("__a") + F.col("__b") * F.col(x)
    out = df.join(F.broadcast(line)).withColumn("fit", fit)
    return out.withColumn("residual", F.col(y) - F.col("fit")).withColumn("multiplier", F.when(F.col("fit") > 0, F.col(y) / F.nullif("fit", F.lit(0.0)))).drop("__a", "__b")


def major_axis(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope and intercept of the line through the means with the ratio of deviations, in log10
    of the positive rows."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("x"), F.log10(y).alias("y"))
    s = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return s.select((F.col("sy") / F.nullif("sx", F.lit(0.0))).alias("slope")).join(F.broadcast(s)).select("slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def tail(df: DataFrame, x: str, y: str, tie: str, k: int = 100, size: str | None = None) -> DataFrame:
    """One row: r over all rows, r without the k largest, their share of the covariance, and the median size
    of the k largest and of the rest."""
    order = Window.orderBy(F.desc(F.abs(x) + F.abs(y)), tie)
    means = df.agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    rows = df.withColumn("__k", F.row_number().over(order)).join(F.broadcast(means))
    product = (F.col(x) - F.col("__mx")) * (F.col(y) - F.col("__my"))
    out = F.col("__k") > k
    return rows.agg(
        pearson(F.col(x), F.col(y)).alias("r_full"),
        pearson(F.when(out, F.col(x)), F.when(out, F.col(y))).alias("r_rest"),
        (F.sum(F.when(~out, product).otherwise(0.0)) / F.nullif(F.sum(product), F.lit(0.0))).alias("cov_share"),
        *([F.percentile(F.when(~out, F.col(size)), 0.5).alias("top_size"), F.percentile(F.when(out, F.col(size)), 0.5).alias("rest_size")] if size else []),
    )


def tjur(cells: DataFrame, p: str, k: str, n: str) -> DataFrame:
    """One row, tjur: the mean fitted chance of positives less that of negatives, from grouped cells."""
    p, k, rest = F.col(p), F.col(k), F.col(n) - F.col(k)
    return cells.agg((F.sum(p * k) / F.nullif(F.sum(k), F.lit(0)) - F.sum(p * rest) / F.nullif(F.sum(rest), F.lit(0))).alias("tjur"))


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n and the sums of all products of 1 and the columns, as g_<i>_<j>; one scan whatever the
    number of rows, from which any least-squares fit on these columns follows."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    return df.agg(F.count("*").alias("n"), *[F.sum(terms[i] * terms[j]).alias(f"g_{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))])


#: Cumulative chances of the Poisson distribution of mean 1, whose draws are bootstrap weights.
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(13)])


def replicate_weights(keys: np.ndarray, seed: int, replicates: int) -> np.ndarray:
    """(keys, replicates): the Poisson(1) weight of each key in each replicate, which seed, key and
    replicate decide (by SplitMix64), so it doesn't depend on the order of rows or on tasks."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    each = mixed(mixed(keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed))[:, None] ^ np.arange(1, replicates + 1, dtype=np.uint64))
    return np.searchsorted(_POISSON, (each >> np.uint64(11)) / float(1 << 53), side="right")


def replicated_grams(df: DataFrame, columns: list[str], key: str, seed: int, replicates: int) -> DataFrame:
    """(replicate, g_<i>_<j>): for each bootstrap replicate the weighted sums of all products of 1 and the
    columns, in one scan: a task adds its rows up to one matrix a replicate, and only these are shuffled."""
    pairs = [(i, j) for i in range(len(columns) + 1) for j in range(i, len(columns) + 1)]
    names = [f"g_{i}_{j}" for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((replicates, len(pairs)))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)])
            products = np.column_stack([x[:, i] * x[:, j] for i, j in pairs])
            keys = batch.column(key).to_numpy()
            for at in range(0, len(keys), 256):
                sums += replicate_weights(keys[at : at + 256], seed, replicates).T @ products[at : at + 256]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["replicate", *names])

    rows = df.select(F.col(key).cast("bigint").alias(key), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    parts = rows.mapInArrow(run, "replicate int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def replicated(df: DataFrame, seed: int, replicates: int, key: str) -> DataFrame:
    """df once for each replicate that draws it, with `replicate` and its Poisson(1) weight `w`: for fits that
    need the rows themselves. It depends on keys alone, not on the order of rows."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("replicate"), F.col(key)), F.lit(1 << 53)) / float(1 << 53)
    w = reduce(lambda a, c: a + c, [(u >= c).cast("int") for c in _POISSON.tolist()])
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", w).where("w > 0")


def gram_pearson(prefix: str = "g") -> Column:
    """The correlation of two columns from the sums of their Gram matrix."""
    g = {(i, j): F.col(f"{prefix}_{i}_{j}") for i in range(3) for j in range(i, 3)}
    n = g[0, 0]
    vx, vy = g[1, 1] - g[0, 1] * g[0, 1] / n, g[2, 2] - g[0, 2] * g[0, 2] / n
    return (g[1, 2] - g[0, 1] * g[0, 2] / n) / F.sqrt(F.nullif(vx * vy, F.lit(0.0)))


def bootstrap_interval(df: DataFrame, x: str, y: str, key: str, seed: int = 1, replicates: int = 10_000) -> DataFrame:
    """One row: replicates, low and high, the percentile interval of the correlation."""
    r = replicated_grams(df, [x, y], key, seed, replicates).select(gram_pearson().alias("r"))
    return r.agg(F.count("*").alias("replicates"), F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high"))
