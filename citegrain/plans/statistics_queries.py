"""Queries of statistics: 2.K of the survey, the bootstrap of 2.M, and cells of 2.A."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.operators import graph, solvers, stats, windows
from citegrain.operators import venues as venues_
from citegrain.plans import fixtures as fx
from citegrain.plans.graph_queries import RANK_VIEWS, projected, rank_sql
from citegrain.plans.registry import Registry
from citegrain.plans.window_queries import _HIST, hist
from citegrain.storage import written

registry = Registry()

_VENUES = """v AS (SELECT s.source_id, s.sid, s.source_type, s.jif, p.n, p.total, p.first_year, p.field FROM sources s JOIN (SELECT sid, count(*) AS n, round(sum(price) / 1000, 2) AS total, min(publication_year) AS first_year, min(field) AS field FROM papers GROUP BY sid) p ON s.sid = p.sid WHERE s.jif IS NOT NULL)"""


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.papers(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("n"), F.round(F.sum("price") / 1000, 2).alias("total"), F.min("publication_year").alias("first_year"), F.min("field").alias("field"))
    rows = fx.sources(spark, sf_dir).where("jif IS NOT NULL").join(own, "sid")
    return rows.select("source_id", "sid", "source_type", "jif", "n", "total", "first_year", "field")


@registry("k1_pearson", "sources papers", f"WITH {_VENUES} SELECT source_type, count(*) AS n, round(corr(total, jif), 6) AS r FROM v GROUP BY source_type")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"), F.round(stats.pearson(F.col("total"), F.col("jif")), 6).alias("r"))


@registry("k2_spearman", "sources papers", f"WITH {_VENUES}, r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY jif) + (count(*) OVER (PARTITION BY jif) - 1) / 2.0 AS b FROM v) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(venues(spark, sf_dir), "n", "jif").select("n", F.round("rho", 6).alias("rho"))


@registry("k3_asinh", "sources papers", f"WITH {_VENUES} SELECT round(corr(asinh(total), asinh(jif)), 6) AS agg, round(corr(asinh(total / n * 10000), asinh(jif * 10000)), 6) AS norm FROM v")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n, j = (F.col(c) for c in ("total", "n", "jif"))
    return venues(spark, sf_dir).agg(F.round(stats.pearson(F.asinh(t), F.asinh(j)), 6).alias("agg"), F.round(stats.pearson(F.asinh(t / n * 10000), F.asinh(j * 10000)), 6).alias("norm"))


@registry("k4_fisher", "sources papers", f"WITH {_VENUES}, c AS (SELECT source_type, count(*) AS n, corr(total, jif) AS r FROM v GROUP BY source_type), f AS (SELECT *, tanh(atanh(r) - 1.959964::DOUBLE / sqrt(n - 3)) AS low, tanh(atanh(r) + 1.959964::DOUBLE / sqrt(n - 3)) AS high FROM c) SELECT source_type, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN high - low > 0.2 THEN CASE WHEN low <= 0 AND high >= 0 THEN 'WIDE ZERO' ELSE 'WIDE' END WHEN low <= 0 AND high >= 0 THEN 'ZERO' ELSE '' END AS flags FROM f")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals (K4) and their flags (K5)."""
    rows = venues(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"), stats.pearson(F.col("total"), F.col("jif")).alias("r"))
    low, high = stats.fisher(F.col("r"), F.col("n"))
    return rows.select("source_type", low.alias("low"), high.alias("high")).select("source_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), stats.flagged(F.col("low"), F.col("high")).alias("flags"))


@registry("k6_within_field", "sources papers", f"WITH {_VENUES}, c AS (SELECT field, count(*) AS n, corr(total, jif) AS r FROM v GROUP BY field HAVING count(*) >= 5) SELECT count(*) AS fields, round(median(r), 6) AS median_r, round(min(r), 6) AS min_r, round(max(r), 6) AS max_r FROM c WHERE NOT isnan(r)")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = stats.grouped_correlations(venues(spark, sf_dir), "field", "total", "jif")
    return by.agg(F.count("*").alias("fields"), F.round(F.percentile("r", 0.5), 6).alias("median_r"), F.round(F.min("r"), 6).alias("min_r"), F.round(F.max("r"), 6).alias("max_r"))


@registry("k7_variance", "sources papers", f"WITH {_VENUES}, g AS (SELECT field, count(*) AS n, avg(ln(total)) AS m, var_pop(ln(total)) AS w FROM v GROUP BY field), t AS (SELECT sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * w) AS w FROM g) SELECT round((q - s * s / n) / (q - s * s / n + w), 6) AS r2 FROM t")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.between_share(venues(spark, sf_dir).withColumn("log_total", F.log("total")), "field", "log_total").select(F.round("r2", 6).alias("r2"))


@registry("k8_overperformers", "sources papers", f"WITH {_VENUES}, l AS (SELECT regr_slope(total, jif) AS b, regr_intercept(total, jif) AS a FROM v) SELECT source_id, round(total - a - b * jif, 4) AS residual, round(total / (a + b * jif), 4) AS multiplier FROM v CROSS JOIN l ORDER BY total - a - b * jif DESC, sid LIMIT 30")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.top_k(stats.line_fit(venues(spark, sf_dir), "total", "jif"), 30, "residual", "sid")
    return out.select("source_id", F.round("residual", 4).alias("residual"), F.round("multiplier", 4).alias("multiplier"))


@registry("k9_major_axis", "sources papers", f"WITH {_VENUES}, s AS (SELECT avg(log10(jif)) AS mx, avg(log10(total)) AS my, stddev_pop(log10(jif)) AS sx, stddev_pop(log10(total)) AS sy FROM v WHERE jif > 0 AND total > 0) SELECT round(sy / sx, 6) AS slope, round(my - sy / sx * mx, 6) AS intercept FROM s")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.major_axis(venues(spark, sf_dir), "jif", "total").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


BLOCKS = {"size": [1], "age": [2], "jif": [3], "type": [4, 5, 6], "field": list(range(7, 32))}
TYPES, FIELDS = ("c", "j", "r"), tuple(range(12, 37))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the blocks, then the outcome; of types and fields the first level is left out."""
    t, f = F.col("source_type"), F.col("field")
    return venues(spark, sf_dir).select("sid", F.log("n").alias("size"), (F.col("first_year") - 1995).alias("age"), "jif", *[(t == k).cast("int").alias(k) for k in TYPES], *[(f == k).cast("int").alias(f"f{k}") for k in FIELDS], F.asinh("total").alias("y"))


def _gram(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> np.ndarray:
    rows = _matrix(spark, sf_dir).drop("sid").withColumn("y", F.col("y") * scale)
    return solvers.gram_matrix(stats.gram(rows, rows.columns).first().asDict(), len(rows.columns))


def _r2(g: np.ndarray):  # noqa: ANN202
    return lambda s: solvers.r_squared(g, [i for b in s for i in BLOCKS[b]], len(g) - 1)


_PAIR = "(SELECT 1 AS x) CROSS JOIN (SELECT power(corr(y, a), 2) AS p, power(corr(y, b), 2) AS q, corr(y, a) * corr(y, b) * corr(a, b) AS m, power(corr(a, b), 2) AS w FROM (SELECT asinh(total) AS y, {a} AS a, {b} AS b FROM v))"
_GROUPED = "(SELECT sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * w) AS w FROM (SELECT count(*) AS n, avg(asinh(total)) AS m, var_pop(asinh(total)) AS w FROM v GROUP BY {g}))"
_TERMS = {"size": "ln(n)", "age": "first_year", "jif": "jif"}


@registry("k10_gram_r2", "sources papers", f"WITH {_VENUES} " + " UNION ALL ".join(
    [f"SELECT '{k}' AS blocks, round(regr_r2(asinh(total), {x}), 6) AS r2 FROM v" for k, x in _TERMS.items()]
    + [f"SELECT '{a}+{b}', round((p + q - 2 * m) / (1 - w), 6) FROM " + _PAIR.format(a=_TERMS[a], b=_TERMS[b]) for a, b in (("size", "age"), ("size", "jif"), ("age", "jif"))]
    + [f"SELECT '{k}', round((q - s * s / n) / (q - s * s / n + w), 6) FROM " + _GROUPED.format(g=g) for k, g in (("type", "source_type"), ("field", "field"))]
))
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of the blocks and pairs that SQL can fit, from one Gram matrix; k10_all_subsets has all 32."""
    value = _r2(_gram(spark, sf_dir))
    asked = [("size",), ("age",), ("jif",), ("size", "age"), ("size", "jif"), ("age", "jif"), ("type",), ("field",)]
    return spark.createDataFrame([("+".join(s), round(value(s), 6)) for s in asked], "blocks string, r2 double")


@registry("k10_all_subsets")
def k10_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of all 32 subsets of the five blocks, fields as dummies."""
    value = _r2(_gram(spark, sf_dir))
    subsets = [s for k in range(6) for s in combinations(BLOCKS, k)]
    return spark.createDataFrame([("+".join(s), value(s)) for s in subsets], "blocks string, r2 double")


@registry("k11_shapley")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley shares of R2 over five blocks, and the sequential ones."""
    value = _r2(_gram(spark, sf_dir))
    shares, steps = solvers.shapley(list(BLOCKS), value), solvers.sequential(list(BLOCKS), value)
    return spark.createDataFrame([(b, shares[b], steps[b]) for b in BLOCKS], "block string, shapley double, sequential double")


@registry("k13_anova")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential sums of squares with F tests, for the outcome as it is and in ten-thousandths; fields as a
    factor. The tests don't depend on the scale."""
    rows = []
    for scale in (1.0, 1e4):
        g = _gram(spark, sf_dir, scale)
        rows += [(scale, *r) for r in solvers.anova(BLOCKS, g, len(g) - 1)]
    return spark.createDataFrame(rows, "scale double, block string, df int, sum_sq double, f double, p double")


@registry("k12_samples", "sources papers works", f"WITH {_VENUES}, c AS (SELECT sid, cited_by_count AS c, count(*) AS n FROM works GROUP BY ALL), hx AS (SELECT sid, max(least(c, above)) AS h FROM (SELECT sid, c, sum(n) OVER (PARTITION BY sid ORDER BY c DESC ROWS UNBOUNDED PRECEDING) AS above FROM c) GROUP BY sid), a AS (SELECT sid, round(sum(price) / 1000, 2) AS total, count(*) AS n FROM papers WHERE type = 'article' GROUP BY sid), e AS (SELECT s.sid, s.jif, p.n, p.total, hx.h, a.total AS atotal, a.n AS an FROM sources s JOIN (SELECT sid, count(*) AS n, round(sum(price) / 1000, 2) AS total FROM papers GROUP BY sid) p ON s.sid = p.sid JOIN hx ON hx.sid = s.sid LEFT JOIN a ON a.sid = s.sid) SELECT 'jif' AS sample, count(*) AS n, round(regr_r2(asinh(total), jif), 6) AS r2 FROM e WHERE jif IS NOT NULL UNION ALL SELECT 'h-index', count(*), round(regr_r2(asinh(total), h), 6) FROM e WHERE h > 0 UNION ALL SELECT 'h-index, with jif', count(*), round(regr_r2(asinh(total), h), 6) FROM e WHERE h > 0 AND jif IS NOT NULL UNION ALL SELECT 'articles', count(*), round(regr_r2(asinh(atotal), jif), 6) FROM e WHERE jif IS NOT NULL AND an > 0 UNION ALL SELECT 'floor 10', count(*), round(regr_r2(asinh(total), jif), 6) FROM e WHERE jif IS NOT NULL AND n >= 10 UNION ALL SELECT 'floor 12', count(*), round(regr_r2(asinh(total), jif), 6) FROM e WHERE jif IS NOT NULL AND n >= 12")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fit in variants of the sample: by outside metric, h-index, articles only, floors of size."""
    papers = fx.papers(spark, sf_dir)
    own = lambda rows, a, b: rows.groupBy("sid").agg(F.count("*").alias(a), F.round(F.sum("price") / 1000, 2).alias(b))
    h = venues_.h_index(fx.works(spark, sf_dir).withColumn("source_id", F.col("sid"))).withColumnRenamed("source_id", "sid")
    rows = fx.sources(spark, sf_dir).select("sid", "jif").join(own(papers, "n", "total"), "sid").join(h, "sid").join(own(papers.where("type = 'article'"), "an", "atotal"), "sid", "left")
    variants = {"jif": ("jif IS NOT NULL", "total", "jif"), "h-index": ("h > 0", "total", "h"), "h-index, with jif": ("h > 0 AND jif IS NOT NULL", "total", "h"), "articles": ("jif IS NOT NULL AND an > 0", "atotal", "jif"), "floor 10": ("jif IS NOT NULL AND n >= 10", "total", "jif"), "floor 12": ("jif IS NOT NULL AND n >= 12", "total", "jif")}
    inside = {k: F.coalesce(F.expr(w), F.lit(False)) for k, (w, _, _) in variants.items()}
    aggs = [c for k, (_, y, x) in variants.items() for c in (F.count_if(inside[k]).alias(f"n {k}"), F.regr_r2(F.when(inside[k], F.asinh(y)), F.when(inside[k], F.col(x).cast("double"))).alias(f"r {k}"))]
    return rows.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(k).alias("sample"), F.col(f"`n {k}`").alias("n"), F.round(F.col(f"`r {k}`"), 6).alias("r2")) for k in variants])))


@registry("k16_hurdle")
def k16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-part model of venues' seed papers: whether there are any, and the logarithm of how many. Rows
    are venues; one task fits them."""
    seeds = fx.papers(spark, sf_dir).groupBy("sid").agg(F.count_if((F.col("priority") == "1-URGENT") & (F.col("type") == "article")).cast("double").alias("k"))
    rows = venues(spark, sf_dir).join(seeds, "sid")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        beta, gamma, d2, r2 = solvers.hurdle_fit(_design(pdf, ("size", "jif")), pdf["k"].to_numpy())
        return pd.DataFrame({"term": ["intercept", "size", "jif"], "any": beta, "amount": gamma, "d2": d2, "r2": r2})

    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(fit, "term string, any double, amount double, d2 double, r2 double")


def _design(pdf: pd.DataFrame, blocks: tuple[str, ...]) -> np.ndarray:
    columns = {"size": [np.log(pdf["n"])], "age": [pdf["first_year"] - 1995.0], "jif": [pdf["jif"]], "type": [(pdf["source_type"] == k).astype(float) for k in ("c", "j", "r")]}
    return np.column_stack([np.ones(len(pdf)), *[c for b in blocks for c in columns[b]]])


@registry("k14_quantile")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 of quantile regressions at four quantiles, shared out to blocks; one task a quantile."""
    rows = venues(spark, sf_dir).withColumn("tau", F.explode(F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95)))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tau, y = float(pdf["tau"].iloc[0]), np.arcsinh(pdf["total"].to_numpy())
        shares = solvers.shapley(["size", "jif", "type"], lambda s: solvers.quantile_r1(_design(pdf, s), y, tau) if s else 0.0)
        return pd.DataFrame([(tau, b, x) for b, x in shares.items()], columns=["tau", "block", "share"])

    return rows.groupBy("tau").applyInPandas(fit, "tau double, block string, share double")


@registry("k15_quantile_bootstrap")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of R1 at 0.95 over 200 replicates, with the outside metric and with the h-index;
    each replicate is fitted in its own task."""
    h = venues_.h_index(fx.works(spark, sf_dir).withColumn("source_id", F.col("sid"))).select(F.col("source_id").alias("sid"), F.col("h").cast("double").alias("h"))
    rows = stats.replicated(venues(spark, sf_dir).join(h, "sid"), 15, 200, "sid")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["w"])]
        y = np.arcsinh(pdf["total"].to_numpy())
        found = [(m, solvers.quantile_r1(_design(pdf.assign(jif=pdf[m]), ("size", "jif")), y, 0.95)) for m in ("jif", "h")]
        return pd.DataFrame([(int(pdf["replicate"].iloc[0]), m, r) for m, r in found], columns=["replicate", "metric", "r1"])

    r = rows.groupBy("replicate").applyInPandas(fit, "replicate int, metric string, r1 double")
    return r.groupBy("metric").agg(F.count("*").alias("replicates"), F.percentile("r1", 0.025).alias("low"), F.percentile("r1", 0.975).alias("high"))


@registry("a22_cells", "works", f"WITH {_HIST} SELECT field, year, CAST(bin AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM bins GROUP BY field, year, bin")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = windows.midranks(hist(spark, sf_dir), ["field", "year"])
    return ranked.groupBy("field", "year", "bin").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


@registry("a23_dose", "works", f"WITH {_HIST}, d AS (SELECT bin, sum(n) AS n, sum(k) AS k FROM bins GROUP BY bin) SELECT CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS rate, round((k / n) / first_value(k / n) OVER (ORDER BY bin), 4) AS ratio FROM d")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by citation bin, and each over that of the lowest bin."""
    by = cells(spark, sf_dir).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("p", F.col("k") / F.col("n"))
    return by.select("bin", "n", "k", F.round("p", 6).alias("rate"), F.round(F.col("p") / F.first("p").over(Window.orderBy("bin")), 4).alias("ratio"))


@registry("k17_binomial")
def k17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped binomial model on cells, its deviance explained shared out to blocks, with the
    likelihood ratio of each block and the complementary log-log link beside it."""
    pdf = cells(spark, sf_dir).toPandas()  # fields x years x bins
    x = {b: pd.get_dummies(pdf[b], drop_first=True).to_numpy(float) for b in ("field", "year", "bin")}
    k, n, one = pdf["k"].to_numpy(float), pdf["n"].to_numpy(float), np.ones((len(pdf), 1))
    found: dict = {}

    def deviance(s: tuple[str, ...], link: str = "logit") -> float:
        if (s, link) not in found:
            found[s, link] = solvers.binomial_fit(np.hstack([one, *[x[b] for b in s]]), k, n, link)[1]
        return found[s, link]

    null, blocks = deviance(()), ["field", "year", "bin"]
    shares = solvers.shapley(blocks, lambda s: 1 - deviance(s) / null)
    rows = [(b, shares[b], deviance(tuple(c for c in blocks if c != b)) - deviance(tuple(blocks)), 1 - deviance(tuple(blocks), "cloglog") / deviance((), "cloglog")) for b in blocks]
    return spark.createDataFrame(rows, "block string, d2_share double, likelihood_ratio double, cloglog_d2 double")


@registry("k18_auc", "works", f"WITH {_HIST}, s AS (SELECT bin AS score, sum(k) AS p, sum(n - k) AS q FROM bins GROUP BY bin), b AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(p * (below + q / 2)) / sum(p) / sum(q), 6) AS auc FROM b")
def k18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).select("bin", F.col("k").alias("p"), (F.col("n") - F.col("k")).alias("q"))
    return windows.auc(rows, "bin", "p", "q").select(F.round("auc", 6).alias("auc"))


@registry("k18_tjur", "works", f"WITH {_HIST}, s AS (SELECT bin, sum(k) AS k, sum(n) AS n FROM bins GROUP BY bin), p AS (SELECT *, k / n AS p FROM s) SELECT round(sum(p * k) / sum(k) - sum(p * (n - k)) / sum(n - k), 6) AS tjur FROM p")
def k18_tjur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tjur's R2 of the rates by citation bin."""
    by = cells(spark, sf_dir).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("p", F.col("k") / F.col("n"))
    return stats.tjur(by, "p", "k", "n").select(F.round("tjur", 6).alias("tjur"))


@registry("k17_linear", "works", f"WITH {_HIST}, s AS (SELECT bin, sum(k) AS k, sum(n) AS n FROM bins GROUP BY bin), t AS (SELECT sum(n) AS n, sum(n * bin) AS x, sum(n * bin * bin) AS xx, sum(k) AS y, sum(k * bin) AS xy FROM s) SELECT round((xy - x * y / n) / (xx - x * x / n), 8) AS slope, round(power(xy - x * y / n, 2) / (xx - x * x / n) / (y - y * y / n), 8) AS r2 FROM t")
def k17_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear probability model of being a seed on the citation bin, from grouped counts."""
    b, n, k = F.col("bin"), F.col("n"), F.col("k")
    t = cells(spark, sf_dir).agg(F.sum(n).alias("n"), F.sum(n * b).alias("x"), F.sum(n * b * b).alias("xx"), F.sum(k).alias("y"), F.sum(k * b).alias("xy"))
    n, x, xx, y, xy = (F.col(c).cast("double") for c in ("n", "x", "xx", "y", "xy"))
    sxy, sxx, syy = xy - x * y / n, xx - x * x / n, y - y * y / n
    return t.select(F.round(sxy / sxx, 8).alias("slope"), F.round(sxy * sxy / sxx / syy, 8).alias("r2"))


@registry("k19_tail", "sources papers", f"WITH {_VENUES}, r AS (SELECT *, row_number() OVER (ORDER BY abs(total) + abs(jif) DESC, sid) AS k, (total - avg(total) OVER ()) * (jif - avg(jif) OVER ()) AS c FROM v) SELECT round(corr(total, jif), 6) AS r_full, round(corr(total, jif) FILTER (k > 100), 6) AS r_rest, round(sum(c) FILTER (k <= 100) / sum(c), 4) AS cov_share, quantile_cont(n, 0.5) FILTER (k <= 100) AS top_size, quantile_cont(n, 0.5) FILTER (k > 100) AS rest_size FROM r")
def k19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tail(venues(spark, sf_dir), "total", "jif", "sid", size="n").select(F.round("r_full", 6).alias("r_full"), F.round("r_rest", 6).alias("r_rest"), F.round("cov_share", 4).alias("cov_share"), "top_size", "rest_size")


_SCORED = f"""{RANK_VIEWS}, {rank_sql(0.85, name="a")}, {rank_sql(0.95, name="b")},
sc AS (SELECT p.sid, round(sum(a.r), 9) AS low, round(sum(b.r), 9) AS high, count(*) AS works, count(h.hop) FILTER (h.hop = 0) AS c0, count(h.hop) FILTER (h.hop <= 1) AS c1, count(h.hop) FILTER (h.hop <= 5) AS c5, count(h.hop) AS cinf FROM papers p LEFT JOIN hops h ON p.wid = h.id LEFT JOIN a20 a ON p.wid = a.id LEFT JOIN b20 b ON p.wid = b.id GROUP BY p.sid)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with scores at two dampings, works, and how many of these lie within 0, 1, 5 and any hops."""
    nodes, edges = projected(spark, sf_dir)
    nodes = written(nodes, "nodes")
    ranks = graph.article_rank(nodes, edges, dict.fromkeys(("low", "high"), F.col("hop") == 0), {"low": 0.85, "high": 0.95})
    rows = fx.papers(spark, sf_dir).select("sid", F.col("wid").alias("id")).join(nodes, "id", "left").join(ranks, "id", "left")
    return written(rows.groupBy("sid").agg(F.round(F.sum("low"), 9).alias("low"), F.round(F.sum("high"), 9).alias("high"), F.count("*").alias("works"), *[F.count_if(F.col("hop") <= d).alias(f"c{d}") for d in (0, 1, 5)], F.count("hop").alias("cinf")), "scored")


@registry("k21_damping", "hops papers", f"WITH {_SCORED}, v AS (SELECT * FROM sc WHERE low IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY low) + (count(*) OVER (PARTITION BY low) - 1) / 2.0 AS x, rank() OVER (ORDER BY high) + (count(*) OVER (PARTITION BY high) - 1) / 2.0 AS y FROM v) SELECT count(*) AS n, round(corr(low, high), 6) AS r, round(corr(x, y), 6) AS rho, (SELECT count(*) FROM (SELECT sid FROM (SELECT sid FROM v ORDER BY low DESC, sid LIMIT 100) INTERSECT SELECT sid FROM (SELECT sid FROM v ORDER BY high DESC, sid LIMIT 100))) AS top100 FROM r")
def k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far venues' scores at dampings of 0.85 and 0.95 agree: r, rho and the overlap of the best hundred."""
    rows = scored(spark, sf_dir).where("low IS NOT NULL")
    both = windows.top_k(rows, 100, "low", "sid").select("sid").intersect(windows.top_k(rows, 100, "high", "sid").select("sid")).agg(F.count("*").alias("top100"))
    r = rows.agg(F.round(stats.pearson(F.col("low"), F.col("high")), 6).alias("r"))
    return stats.spearman(rows, "low", "high").select("n", F.round("rho", 6).alias("rho")).join(F.broadcast(r)).join(F.broadcast(both))


@registry("k22_cn", "hops papers", f"WITH {_SCORED} " + " UNION ALL ".join(f"SELECT '{c}' AS measure, round(corr({c}, low), 6) AS raw, round(corr({c} / works, low / works), 6) AS normalised FROM sc WHERE low IS NOT NULL" for c in ("c0", "c1", "c5", "cinf")))
def k22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of works within some hops against scores, as they are and for each work."""
    low, works = F.col("low"), F.col("works")
    names = ("c0", "c1", "c5", "cinf")
    out = scored(spark, sf_dir).where("low IS NOT NULL").agg(*[x for c in names for x in (F.round(stats.pearson(F.col(c), low), 6).alias(f"raw_{c}"), F.round(stats.pearson(F.col(c) / works, low / works), 6).alias(f"norm_{c}"))])
    return out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"raw_{c}").alias("raw"), F.col(f"norm_{c}").alias("normalised")) for c in names])))


@registry("k23_prestige", "sources papers", "WITH a AS (SELECT sid, coalesce(sum(price) FILTER (type = 'article'), 0) AS x, coalesce(sum(price) FILTER (priority = '1-URGENT'), 0) AS y, count(*) AS works FROM papers GROUP BY sid), e AS (SELECT a.*, s.jif FROM a JOIN sources s ON a.sid = s.sid), d AS (SELECT 'article' AS definition, sid, x AS v, jif, works FROM e UNION ALL SELECT 'urgent', sid, y, jif, works FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY definition ORDER BY v DESC, sid) AS k FROM d) SELECT definition, count(*) FILTER (v > 0) AS covered, round(count(*) FILTER (v > 0) / count(*), 6) AS coverage, round(avg(jif) FILTER (k <= 20), 4) AS prestige, round(sum(works) FILTER (v > 0) / sum(works), 6) AS works_covered FROM r GROUP BY definition")
def k23_prestige(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each definition covers, and the mean outside metric of its best twenty venues."""
    price, v = F.col("price"), F.col("v")
    rows = fx.papers(spark, sf_dir).groupBy("sid").agg(F.sum(F.when(F.col("type") == "article", price).otherwise(0.0)).alias("x"), F.sum(F.when(F.col("priority") == "1-URGENT", price).otherwise(0.0)).alias("y"), F.count("*").alias("works"))
    rows = rows.join(fx.sources(spark, sf_dir).select("sid", "jif"), "sid")
    rows = rows.select("sid", "jif", "works", F.inline(F.array(F.struct(F.lit("article").alias("definition"), F.col("x").alias("v")), F.struct(F.lit("urgent").alias("definition"), F.col("y").alias("v")))))
    out = windows.ordinal(rows, "v", "sid", "k", ("definition",)).groupBy("definition")
    return out.agg(F.count_if(v > 0).alias("covered"), F.round(F.count_if(v > 0) / F.count("*"), 6).alias("coverage"), F.round(F.avg(F.when(F.col("k") <= 20, F.col("jif"))), 4).alias("prestige"), F.round(F.sum(F.when(v > 0, F.col("works")).otherwise(0)) / F.sum("works"), 6).alias("works_covered"))


@registry("k23_universes", "papers", "WITH a AS (SELECT sid, coalesce(sum(price) FILTER (type = 'article'), 0) AS x, coalesce(sum(price) FILTER (priority = '1-URGENT'), 0) AS y FROM papers GROUP BY sid), u AS (SELECT 'all' AS universe, * FROM a UNION ALL SELECT 'union', * FROM a WHERE x > 0 OR y > 0 UNION ALL SELECT 'inter', * FROM a WHERE x > 0 AND y > 0) SELECT universe, count(*) AS n, round(corr(x, y), 6) AS r, round(corr(asinh(x * 10000), asinh(y * 10000)), 6) AS r_asinh FROM u GROUP BY universe")
def k23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two definitions in three universes, in one scan."""
    x, y = F.col("x"), F.col("y")
    rows = fx.papers(spark, sf_dir).groupBy("sid").agg(F.sum(F.when(F.col("type") == "article", F.col("price")).otherwise(0.0)).alias("x"), F.sum(F.when(F.col("priority") == "1-URGENT", F.col("price")).otherwise(0.0)).alias("y"))
    member = F.array_compact(F.array(F.lit("all"), F.when((x > 0) | (y > 0), "union"), F.when((x > 0) & (y > 0), "inter")))
    return rows.withColumn("universe", F.explode(member)).groupBy("universe").agg(F.count("*").alias("n"), F.round(stats.pearson(x, y), 6).alias("r"), F.round(stats.pearson(F.asinh(x * 10000), F.asinh(y * 10000)), 6).alias("r_asinh"))


@registry("m4_bootstrap")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile interval of a correlation from 10,000 replicates; weights depend on rows' keys alone."""
    return stats.bootstrap_interval(venues(spark, sf_dir), "total", "jif", "sid")


@registry("m5_gram_bootstrap")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of R2 from one weighted Gram matrix for each of 1,000 replicates, all formed in one scan."""
    rows = venues(spark, sf_dir).select("sid", F.log("n").alias("a"), F.col("jif").alias("b"), F.asinh("total").alias("y"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"r2": [solvers.r_squared(solvers.gram_matrix(r, 3), [1, 2], 3) for r in pdf.to_dict("records")]})

    r = stats.replicated_grams(rows, ["a", "b", "y"], "sid", 5, 1000).mapInPandas(fit, "r2 double")
    return r.agg(F.count("*").alias("replicates"), F.percentile("r2", 0.025).alias("low"), F.percentile("r2", 0.975).alias("high"))
