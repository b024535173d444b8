"""Queries of roll-ups to venues, years and fields: 2.A of the survey and the filters they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.operators import contracts, release, venues
from citegrain.plans import fixtures as fx
from citegrain.plans.graph_queries import RANK_VIEWS, hops, rank_sql, ranked
from citegrain.plans.registry import Registry

registry = Registry()


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their venue's name and type and their hops."""
    papers = fx.papers(spark, sf_dir).join(fx.sources(spark, sf_dir).select("sid", "source_name", "source_type"), "sid")
    return papers.join(hops(spark, sf_dir).withColumnRenamed("id", "wid"), "wid", "left")


_PLACED = "q AS (SELECT p.*, s.source_name, s.source_type, h.hop FROM papers p JOIN sources s ON p.sid = s.sid LEFT JOIN hops h ON p.wid = h.id)"


def _depth_sql(depths: list[int], digits: int) -> str:
    return ", ".join(f"count(*) FILTER (hop <= {d}) AS reachable_papers_d{d}, count(*) - count(*) FILTER (hop <= {d}) AS unreachable_papers_d{d}, round(count(*) FILTER (hop <= {d}) / count(*)::DOUBLE, {digits}) AS reachability_rate_d{d}" for d in depths)


def _venue_sql(where: str, least: int) -> str:
    return f"""WITH {_PLACED} SELECT source_id, max(source_name) AS source_name, max(source_type) AS source_type, count(*) AS total_papers, count(*) FILTER (source_type = 'j') AS journal_papers,
  count(*) FILTER (source_type = 'c') AS conference_papers, count(hop) AS reachable_papers, count(*) - count(hop) AS unreachable_papers, round(count(hop) / count(*)::DOUBLE, 4) AS reachability_rate,
  round(avg(hop), 2) AS avg_min_hops, round(quantile_cont(hop, 0.5), 2) AS median_min_hops, {_depth_sql([0, 1, 5, 10], 4)} FROM q {where} GROUP BY source_id HAVING count(*) >= {least}"""


@registry("a3_venue_reach", "papers sources hops", _venue_sql("", 5))
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.venue_reachability(placed(spark, sf_dir), [0, 1, 5, 10], 5).orderBy(F.desc("reachable_papers"), "source_id")


@registry("f5_article_reach", "papers sources hops", _venue_sql("WHERE lower(coalesce(type, '')) = 'article'", 1))
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.venue_reachability(placed(spark, sf_dir), [10, 5, 1, 0, -1, 5], 1, article_only=True)


_LONG = """long AS (SELECT source_id, source_type, 'all' AS scope, k AS score, count(*) AS total_papers, count(v) AS scored_papers, sum(coalesce(v, 0)) AS t FROM x GROUP BY ALL
  UNION ALL SELECT source_id, source_type, 'articles', k, count(*) FILTER (type = 'article'), count(v) FILTER (type = 'article'), coalesce(sum(coalesce(v, 0)) FILTER (type = 'article'), 0) FROM x GROUP BY source_id, source_type, k)
SELECT source_id, source_type, scope, score, total_papers, scored_papers, round(t, 6) AS total_score, round(t / total_papers, 6) AS avg_score_all FROM long WHERE total_papers >= 3"""


@registry("a4_venue_par_multi", "papers sources hops", f"WITH {RANK_VIEWS}, {rank_sql()}, {_PLACED}, x AS (SELECT q.source_id, q.source_type, q.type, k, CASE k WHEN 'par' THEN r.r ELSE q.hop END AS v FROM q LEFT JOIN r20 r ON q.wid = r.id, (VALUES ('par'), ('hops')) AS ks(k)), {_LONG}")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two properties in two scopes in one scan of the papers."""
    scores = ranked(spark, sf_dir).withColumnsRenamed({"id": "wid", "score": "par"})
    rows = placed(spark, sf_dir).join(scores, "wid", "left").withColumn("hops", F.col("hop").cast("double"))
    return venues.venue_scores(rows, ["par", "hops"], min_papers=3)


@registry("a8_year", "papers sources hops", f"""WITH {RANK_VIEWS}, {rank_sql()}, {_PLACED}, x AS (SELECT q.*, r.r AS score FROM q LEFT JOIN r20 r ON q.wid = r.id)
SELECT publication_year, count(*) AS total_papers, count(hop) AS reachable_papers, count(*) - count(hop) AS unreachable_papers, round(count(hop) / count(*)::DOUBLE, 6) AS reachability_rate, round(avg(hop), 6) AS avg_min_hops,
  round(quantile_cont(hop, 0.5), 6) AS median_min_hops, count(score) AS scored_papers, round(sum(coalesce(score, 0)), 6) AS par_total_score, round(avg(coalesce(score, 0)), 6) AS par_avg_score_all, round(avg(score), 6) AS par_avg_score_scored, {_depth_sql([0, 5], 6)}
FROM x GROUP BY publication_year""")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir).join(ranked(spark, sf_dir).withColumnRenamed("id", "wid"), "wid", "left")
    return venues.year_rollup(rows, [0, 5])


@registry("a8_year_reachability", "papers sources hops", f"WITH {_PLACED} SELECT publication_year, count(*) AS total_papers, count(hop) AS reachable_papers, count(*) - count(hop) AS unreachable_papers, round(count(hop) / count(*)::DOUBLE, 6) AS reachability_rate, round(avg(hop), 6) AS avg_min_hops, round(quantile_cont(hop, 0.5), 6) AS median_min_hops, {_depth_sql([1], 6)} FROM q WHERE type = 'article' GROUP BY publication_year HAVING count(*) >= 20")
def a8_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.year_rollup(placed(spark, sf_dir).withColumn("score", F.lit(None).cast("double")), [1], 20, article_only=True, target="reachability")


@registry("a9_year_stats", "papers", "SELECT source_id, count(*) AS n_yr, min(publication_year) AS first_year, round(quantile_cont(publication_year, 0.05), 4) AS p05_year, round(avg(publication_year), 4) AS mean_year, round(quantile_cont(publication_year, 0.5), 4) AS median_year, max(publication_year) AS last_year FROM papers GROUP BY source_id")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = venues.venue_years(fx.papers(spark, sf_dir))
    return out.select("source_id", "n_yr", "first_year", F.round("p05_year", 4).alias("p05_year"), F.round("mean_year", 4).alias("mean_year"), F.round("median_year", 4).alias("median_year"), "last_year")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A venue's topics are the fields of its papers in order of date, each counting its line items' share."""
    order = Window.partitionBy("source_id").orderBy("publication_date", "wid")
    return fx.papers(spark, sf_dir).select("source_id", "field", (F.col("wid") % 3).alias("n"), (F.row_number().over(order) - 1).alias("place"))


_TOPICS = "topics AS (SELECT source_id, field, wid % 3 AS n, row_number() OVER (PARTITION BY source_id ORDER BY publication_date, wid) - 1 AS place FROM papers), fc AS (SELECT source_id, field, CAST(sum(n) AS BIGINT) AS n, min(place) AS place FROM topics GROUP BY source_id, field)"


@registry("a10_field_counts", "papers", f"WITH {_TOPICS} SELECT source_id, field, n, place FROM fc")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.field_counts(topics(spark, sf_dir))


@registry("a11_primary_field", "papers", f"WITH {_TOPICS} SELECT source_id, arg_max(field, n * 100000 - place) AS primary_field, round(max(n) / greatest(sum(n), 1)::DOUBLE, 4) AS primary_field_share FROM fc GROUP BY source_id")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = venues.primary_field(venues.field_counts(topics(spark, sf_dir)))
    return out.select("source_id", "primary_field", F.round(F.col("n") / F.greatest("all", F.lit(1)), 4).alias("primary_field_share"))


@registry("a12_shares", "papers", f"WITH {_TOPICS}, t AS (SELECT source_id, sum(n) AS t FROM fc GROUP BY source_id HAVING sum(n) > 0) SELECT t.source_id, " + ", ".join(f"round(coalesce(sum(n) FILTER (field = {f}), 0) / any_value(t.t)::DOUBLE, 4) AS fs_{f}" for f in range(11, 37)) + " FROM t JOIN fc ON t.source_id = fc.source_id GROUP BY t.source_id")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = venues.field_counts(topics(spark, sf_dir))
    some = counts.groupBy("source_id").agg(F.sum("n").alias("t")).where("t > 0").select("source_id")
    out = venues.field_shares(counts.join(some, "source_id", "left_semi"), list(range(11, 37)))
    return out.select("source_id", *[F.round(f"fs_{f}", 4).alias(f"fs_{f}") for f in range(11, 37)])


@registry("a13_hist", "works", "SELECT field, publication_year AS year, cited_by_count AS cites, count(*) AS n, count(*) FILTER (priority = '1-URGENT') AS k_urgent, count(*) FILTER (priority = '2-HIGH') AS k_high, count(*) FILTER (type = 'article') AS k_article FROM works GROUP BY ALL")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("priority")
    return venues.histogram(fx.works(spark, sf_dir), {"k_urgent": p == "1-URGENT", "k_high": p == "2-HIGH", "k_article": F.col("type") == "article"})


_FLAGS = {
    "k_urgent": "priority = '1-URGENT'", "k_high": "priority = '2-HIGH'", "k_medium": "priority = '3-MEDIUM'", "k_article": "type = 'article'",
    "k_preprint": "type = 'preprint'", "k_dear": "price > 200000", "k_third": "wid % 3 = 0",
}


def _gaps(rows: DataFrame) -> DataFrame:
    """Some keys are missing."""
    return rows.withColumn("field", F.when(F.col("wid") % 13 != 0, F.col("field"))).withColumn("publication_year", F.when(F.col("wid") % 17 != 0, F.col("publication_year"))).withColumn("type", F.when(F.col("wid") % 19 != 0, F.col("type")))


_GAPS = "g AS (SELECT wid, price, priority, cited_by_count, CASE WHEN wid % 13 <> 0 THEN field END AS field, CASE WHEN wid % 17 <> 0 THEN publication_year END AS publication_year, CASE WHEN wid % 19 <> 0 THEN type END AS type FROM works)"


@registry("a13_seven_flags", "works", f"WITH {_GAPS} SELECT coalesce(field, -1) AS field, coalesce(publication_year, -1) AS year, cited_by_count AS cites, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _FLAGS.items()) + " FROM g GROUP BY 1, 2, 3")
def a13_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven flags over three keys, some of them missing."""
    return venues.histogram(_gaps(fx.works(spark, sf_dir)), {k: F.expr(c) for k, c in _FLAGS.items()})


@registry("a13_audit", "works", f"WITH {_GAPS} SELECT 'total' AS tally, 'papers' AS name, count(*) AS n FROM g UNION ALL SELECT 'missing', 'no_field', count(*) FILTER (field IS NULL) FROM g UNION ALL SELECT 'missing', 'no_year', count(*) FILTER (publication_year IS NULL) FROM g UNION ALL SELECT 'missing', 'no_cites', count(*) FILTER (cited_by_count IS NULL) FROM g UNION ALL " + " UNION ALL ".join(f"SELECT 'flag', '{k}', count(*) FILTER ({c}) FROM g" for k, c in _FLAGS.items()) + " UNION ALL SELECT 'type', coalesce(type, 'none'), count(*) FROM g GROUP BY ALL")
def a13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.histogram_audit(_gaps(fx.works(spark, sf_dir)), {k: F.expr(c) for k, c in _FLAGS.items()})


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with a title, which some lack, and a score, which others lack."""
    k = F.col("wid") % 12
    title = F.when(k == 0, "Deleted Work").when(k == 1, F.concat(F.lit("Erratum: "), F.col("id"))).when(k == 2, F.concat(F.lit(" CORRECTION to "), F.col("id"))).when(k > 3, F.concat(F.lit("On "), F.col("id")))
    return fx.papers(spark, sf_dir).withColumns({"title": title, "score": F.when(F.col("wid") % 5 != 0, F.col("price"))})


_TITLED = "t AS (SELECT *, CASE wid % 12 WHEN 0 THEN 'Deleted Work' WHEN 1 THEN 'Erratum: ' || id WHEN 2 THEN ' CORRECTION to ' || id WHEN 3 THEN NULL ELSE 'On ' || id END AS title, CASE WHEN wid % 5 <> 0 THEN price END AS score FROM papers)"


@registry("f8_usable", "papers", f"WITH {_TITLED} SELECT wid, title FROM t WHERE score IS NOT NULL AND type = 'article' AND title IS NOT NULL AND title <> 'Deleted Work'")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return venues.usable_papers(titled(spark, sf_dir), "score").select("wid", "title")


@registry("f9_curated", "papers", f"WITH {_TITLED} SELECT wid FROM t WHERE NOT (lower(trim(coalesce(title, ''))) LIKE 'erratum%' OR lower(trim(coalesce(title, ''))) LIKE 'correction%') AND wid % 50 <> 7")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without notices, by the opening of their titles, and without listed papers."""
    rows = titled(spark, sf_dir)
    return venues.curated(rows, ["erratum", "Correction"], rows.where("wid % 50 = 7").select("id")).select("wid")


@registry("f10_cohort", "works", "WITH h AS (SELECT field, publication_year AS year, cited_by_count AS cites, count(*) AS n FROM works GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY field, year) AS stratum FROM h WHERE year BETWEEN 1996 AND 2000 AND field > 0 AND cites >= 0) SELECT field, year, cites, n, CAST(stratum AS BIGINT) AS stratum FROM s WHERE stratum >= 80")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = venues.histogram(fx.works(spark, sf_dir), {})
    return venues.cohort(rows, 1996, 2000, 80)


@registry("d7_c0", "papers sources", "SELECT s.source_id, count(p.wid) FILTER (p.priority = '1-URGENT') AS c_0, round(count(p.wid) FILTER (p.priority = '1-URGENT') / nullif(count(p.wid) FILTER (p.type = 'article'), 0)::DOUBLE, 6) AS share FROM sources s LEFT JOIN papers p ON s.sid = p.sid GROUP BY s.source_id")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many papers of a venue are seeds, and their share of its works, blank if it has none."""
    own = fx.papers(spark, sf_dir).groupBy("sid").agg(F.count_if(F.col("priority") == "1-URGENT").alias("c_0"), F.count_if(F.col("type") == "article").alias("works"))
    rows = fx.sources(spark, sf_dir).join(own, "sid", "left").fillna(0, ["c_0", "works"])
    return rows.select("source_id", "c_0", F.round(release.share(F.col("c_0"), F.col("works")), 6).alias("share"))


@registry("a14_hops", "papers hops", "SELECT CAST(least(hop, 15) AS INTEGER) AS hops, count(*) AS n, (SELECT count(*) FROM papers) AS total, (SELECT count(*) FROM hops) AS reachable FROM hops GROUP BY 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.papers(spark, sf_dir).select("wid").join(hops(spark, sf_dir).withColumnRenamed("id", "wid"), "wid", "left")
    return venues.hop_histogram(rows)


@registry("a15_composition", "papers", "WITH c AS (SELECT field, type, count(*) AS n FROM papers WHERE priority = '1-URGENT' GROUP BY field, type) SELECT field, type, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(sum(n) OVER (ORDER BY n DESC, field, type ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE, 6) AS cum_share, CAST(row_number() OVER (ORDER BY n DESC, field, type) AS INTEGER) AS rank FROM c")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = venues.composition(fx.papers(spark, sf_dir).where("priority = '1-URGENT'"), ["field", "type"])
    return out.select("field", "type", "n", F.round("share", 6).alias("share"), F.round("cum_share", 6).alias("cum_share"), "rank")


@registry("a15_top_and_other", "papers", "WITH c AS (SELECT field, count(*) AS n FROM papers GROUP BY field), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, field) AS k FROM c) SELECT CASE WHEN k <= 10 THEN CAST(field AS VARCHAR) ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def a15_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = venues.composition(fx.papers(spark, sf_dir), ["field"])
    return out.groupBy(F.when(F.col("rank") <= 10, F.col("field").cast("string")).otherwise("Other").alias("label")).agg(F.sum("n").alias("n"))


@registry("a16_top_slice", "papers", "WITH t AS (SELECT * FROM papers ORDER BY price DESC, wid LIMIT 3000) SELECT field, source_id, count(*) AS papers, round(sum(price), 2) AS total FROM t GROUP BY field, source_id HAVING count(*) >= 2")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = venues.field_venues(fx.papers(spark, sf_dir), "price", 3000, 2)
    return out.select("field", "source_id", "papers", F.round("total", 2).alias("total"))


@registry("a17_norm_field", "papers", "SELECT field, source_id, count(*) AS papers, round(sum(CASE WHEN type = 'article' THEN price ELSE 0 END) / count(*), 4) AS score_norm, max(type) AS type FROM papers GROUP BY field, source_id HAVING count(*) >= 2")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.papers(spark, sf_dir).withColumn("score", F.when(F.col("type") == "article", F.col("price")))
    return venues.field_venues_normalised(rows, "score", 2).select("field", "source_id", "papers", F.round("score_norm", 4).alias("score_norm"), "type")


@registry("a19_quality", "papers hops", "SELECT count(*) AS papers, count(h.id) AS reached, count(*) FILTER (type <> 'article') AS other_types, count(*) FILTER (h.id IS NULL AND type = 'article') AS unreached_articles FROM papers p LEFT JOIN hops h ON p.wid = h.id")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(spark, sf_dir)
    return rows.agg(F.count("*").alias("papers"), F.count("hop").alias("reached"), F.count_if(F.col("type") != "article").alias("other_types"), F.count_if(F.col("hop").isNull() & (F.col("type") == "article")).alias("unreached_articles"))


@registry("a20_dups", "", "SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_partkey) AS kept FROM lineitem GROUP BY ALL HAVING count(*) >= 2")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once, and the row that stays."""
    return fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.min("l_partkey").alias("kept")).where("copies >= 2")


@registry("a21_property_counts", "papers", "SELECT count(*) FILTER (priority IN ('1-URGENT', '2-HIGH')) AS present, count(*) FILTER (priority = '1-URGENT') AS is_true FROM papers")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("priority")
    return contracts.property_counts(fx.papers(spark, sf_dir).withColumn("flag", F.when(p == "1-URGENT", True).when(p == "2-HIGH", False)), "flag")


@registry("f4_year_bounds", "papers", "SELECT 'none' AS bound, count(*) AS n FROM papers UNION ALL SELECT 'low', count(*) FILTER (publication_year >= 1998) FROM papers UNION ALL SELECT 'both', count(*) FILTER (publication_year BETWEEN 1998 AND 1999) FROM papers")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("publication_year")
    counts = fx.papers(spark, sf_dir).agg(F.count("*").alias("none"), F.count_if(y >= 1998).alias("low"), F.count_if(y.between(1998, 1999)).alias("both"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("bound"), F.col(k).alias("n")) for k in ("none", "low", "both")])))


@registry("f7_pool", "papers sources", "SELECT s.source_id, s.source_name, s.source_type, s.jif, p.n AS works FROM sources s JOIN (SELECT sid, count(*) AS n FROM papers GROUP BY sid) p ON s.sid = p.sid WHERE p.n >= 12 AND s.jif IS NOT NULL AND s.source_type IN ('j', 'c') AND s.source_name NOT IN ('Customer#000000001', 'Customer#000000002')")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of venues that are compared: large, typed, measured, not excluded by name."""
    works = fx.papers(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("works")).where("works >= 12")
    pool = fx.sources(spark, sf_dir).where(F.col("jif").isNotNull() & F.col("source_type").isin("j", "c") & ~F.col("source_name").isin("Customer#000000001", "Customer#000000002"))
    return pool.join(works, "sid").select("source_id", "source_name", "source_type", "jif", "works")


@registry("f11_id_bucket", "papers", "SELECT CASE WHEN regexp_full_match(k, '[A-Za-z][0-9]+') THEN CAST(substr(k, 2) AS BIGINT) % 7 ELSE 0 END AS bucket, count(*) AS n FROM (SELECT source_id AS k FROM papers UNION ALL SELECT priority FROM papers) GROUP BY 1")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citegrain.functions.ids import id_bucket

    papers = fx.papers(spark, sf_dir)
    keys = papers.select(F.col("source_id").alias("k")).unionByName(papers.select(F.col("priority").alias("k")))
    return keys.groupBy(id_bucket(F.col("k"), 7).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))
