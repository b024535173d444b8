"""Queries of windows, top-k, sets and sampling: 2.W, 2.T, 2.X and 2.M of the survey."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrain.functions import text, values
from citegrain.operators import contracts, sampling, windows
from citegrain.plans import fixtures as fx
from citegrain.plans.registry import Registry
from citegrain.storage import written

registry = Registry()

DRAWS = [20260802, 20260803, 20260804]
_BIN = "CASE WHEN {0} <= 0.5 THEN 0 WHEN {0} <= 0.75 THEN 1 WHEN {0} <= 0.9 THEN 2 WHEN {0} <= 0.95 THEN 3 WHEN {0} <= 0.99 THEN 4 ELSE 5 END"
_HIST = "hist AS (SELECT field, publication_year AS year, cited_by_count AS cites, count(*) AS n, count(*) FILTER (priority = '1-URGENT' AND wid % 10 = 0) AS k FROM works GROUP BY ALL), mid AS (SELECT *, (sum(n) OVER (PARTITION BY field, year ORDER BY cites ROWS UNBOUNDED PRECEDING) - 0.5 * n) / sum(n) OVER (PARTITION BY field, year) AS midrank, sum(n) OVER (PARTITION BY field, year ORDER BY cites ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY field, year) AS total FROM hist), bins AS (SELECT *, " + _BIN.format("midrank") + " AS bin FROM mid), cells AS (SELECT field, year, bin, CAST(sum(k) AS BIGINT) AS quota, CAST(sum(n) - sum(k) AS BIGINT) AS pool FROM bins GROUP BY field, year, bin)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.works(spark, sf_dir)
    return rows.select("wid", "field", F.col("publication_year").alias("year"), F.col("cited_by_count").alias("cites"), ((F.col("priority") == "1-URGENT") & (F.col("wid") % 10 == 0)).alias("is_seed"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).groupBy("field", "year", "cites").agg(F.count("*").alias("n"), F.count_if("is_seed").alias("k"))


@registry("w1_midrank", "works", f"WITH {_HIST} SELECT field, year, cites, n, round(midrank, 6) AS midrank, CAST(bin AS INTEGER) AS bin FROM bins")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.midranks(hist(spark, sf_dir), ["field", "year"])
    return out.select("field", "year", "cites", "n", F.round("midrank", 6).alias("midrank"), "bin")


@registry("w2_unseen", "works", f"WITH {_HIST}, q AS (SELECT DISTINCT field, year, x AS cites FROM hist, (VALUES (0), (1), (2), (4), (6), (9), (100)) AS v(x)), f AS (SELECT * FROM bins WHERE cites % 2 = 1 OR cites = 0), g AS (SELECT field, year, cites, bin, sum(n) OVER (PARTITION BY field, year ORDER BY cites) AS cum, sum(n) OVER (PARTITION BY field, year) AS total FROM (SELECT field, year, cites, n, " + _BIN.format("mid2") + " AS bin FROM (SELECT *, (sum(n) OVER (PARTITION BY field, year ORDER BY cites) - 0.5 * n) / sum(n) OVER (PARTITION BY field, year) AS mid2 FROM f))), j AS (SELECT q.field, q.year, q.cites, max(g.cum) FILTER (g.cites < q.cites) AS below, max(g.bin) FILTER (g.cites = q.cites) AS own, max(g.total) AS total FROM q JOIN g ON q.field = g.field AND q.year = g.year GROUP BY ALL) SELECT field, year, cites, own IS NOT NULL AS seen, CAST(coalesce(own, " + _BIN.format("coalesce(below, 0) / total") + ") AS INTEGER) AS bin FROM j")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of citation counts that a frame (here one of odd counts and zero) may lack."""
    h = hist(spark, sf_dir)
    ranked = windows.midranks(h.where("cites % 2 = 1 OR cites = 0"), ["field", "year"])
    asked = h.select("field", "year").distinct().withColumn("cites", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 1, 2, 4, 6, 9, 100)])))
    return windows.located(asked, ranked, ["field", "year"]).select("field", "year", "cites", "seen", "bin")


_POOL = "pool AS (SELECT s.source_id, s.sid, s.jif, p.n, p.total FROM sources s JOIN (SELECT sid, count(*) AS n, round(sum(price), 2) AS total FROM papers GROUP BY sid) p ON s.sid = p.sid WHERE s.jif IS NOT NULL)"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with an outside metric (jif), a size (n) and a score (total)."""
    own = fx.papers(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    return fx.sources(spark, sf_dir).where("jif IS NOT NULL").join(own, "sid").select("source_id", "sid", "jif", "n", "total")


@registry("w3_avg_rank", "sources papers", f"WITH {_POOL} SELECT source_id, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS avg_rank FROM pool")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("source_id", windows.average_rank(F.col("n")).cast("double").alias("avg_rank"))


@registry("w4_gap", "sources papers", f"WITH {_POOL}, r AS (SELECT source_id, (rank() OVER (ORDER BY total) + (count(*) OVER (PARTITION BY total) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS a, (rank() OVER (ORDER BY jif) + (count(*) OVER (PARTITION BY jif) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100 AS b FROM pool) SELECT source_id, round(a, 4) AS score_pct, round(b, 4) AS jif_pct, round(a - b, 4) AS gap FROM r")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy())
    rows = pool(spark, sf_dir).select("source_id", (windows.average_rank(F.col("total")) / n * 100).alias("a"), (windows.average_rank(F.col("jif")) / n * 100).alias("b"))
    return rows.select("source_id", F.round("a", 4).alias("score_pct"), F.round("b", 4).alias("jif_pct"), F.round(F.col("a") - F.col("b"), 4).alias("gap"))


@registry("w5_ordinal", "sources papers", f"WITH {_POOL} SELECT source_id, CAST(row_number() OVER (ORDER BY n DESC, sid) AS INTEGER) AS rank FROM pool")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ordinal(pool(spark, sf_dir), "n", "sid").select("source_id", "rank")


@registry("w6_topk_field", "papers", "SELECT field, wid, CAST(k AS INTEGER) AS rank FROM (SELECT field, wid, row_number() OVER (PARTITION BY field ORDER BY price DESC, wid) AS k FROM papers) WHERE k <= 25")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_k(fx.papers(spark, sf_dir), 25, "price", "wid", "field").select("field", "wid", "rank")


@registry("w7_cumshare", "papers", "WITH c AS (SELECT field, count(*) AS n FROM papers GROUP BY field) SELECT field, round(sum(n) OVER (ORDER BY n DESC, field ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE, 6) AS cum_share FROM c")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citegrain.operators import venues

    return venues.composition(fx.papers(spark, sf_dir), ["field"]).select("field", F.round("cum_share", 6).alias("cum_share"))


_MIX = """sm AS (SELECT wid, draw, z3 # (z3 >> 31) AS x FROM (SELECT wid, draw, ((y2::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z3 FROM (SELECT wid, draw, xor(z2, z2 >> 27) AS y2 FROM (SELECT wid, draw, ((y1::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z2 FROM (SELECT wid, draw, xor(z1, z1 >> 30) AS y1 FROM (SELECT wid, draw, ((xor(wid, draw)::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z1 FROM {rows}))))))"""
_MIX = _MIX.replace("z3 # (z3 >> 31)", "xor(z3, z3 >> 31)")


@registry("n19_splitmix64", "", f"WITH {_MIX.format(rows='(SELECT o_orderkey AS wid, 20260802 AS draw FROM orders)')} SELECT wid, CAST(x AS VARCHAR) AS mixed FROM sm")
def n19(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = values.splitmix64(F.col("o_orderkey").bitwiseXOR(F.lit(DRAWS[0])))
    rows = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("wid"), x.alias("x"))
    wide = F.col("x").cast("decimal(20,0)")
    return rows.select("wid", F.when(F.col("x") < 0, wide + F.lit(Decimal(1 << 64))).otherwise(wide).cast("decimal(20,0)").cast("string").alias("mixed"))


@registry("m1_frame", "works", f"WITH {_HIST} SELECT field, year, CAST(bin AS INTEGER) AS bin, quota, pool FROM cells")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.frame(hist(spark, sf_dir), "k")[1]


_DRAW = f"""{_HIST}, cand AS (SELECT w.wid, w.field, w.publication_year AS year, b.bin, c.quota, d.draw FROM works w JOIN bins b ON w.field = b.field AND w.publication_year = b.year AND w.cited_by_count = b.cites JOIN cells c ON c.field = b.field AND c.year = b.year AND c.bin = b.bin, (VALUES (20260802), (20260803), (20260804)) AS d(draw) WHERE c.quota > 0 AND NOT (priority = '1-URGENT' AND wid % 10 = 0)),
{_MIX.format(rows='cand')}, drawn AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.draw, c.field, c.year, c.bin ORDER BY s.x, c.wid) AS k FROM cand c JOIN sm s ON c.wid = s.wid AND c.draw = s.draw) WHERE k <= quota)"""


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ranked, cells = sampling.frame(hist(spark, sf_dir), "k")
    return sampling.draws(papers(spark, sf_dir), ranked, cells, DRAWS), cells


@registry("m2_draw", "works", f"WITH {_DRAW} SELECT CAST(draw AS INTEGER) AS draw, field, year, CAST(bin AS INTEGER) AS bin, wid FROM drawn")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir)[0]


@registry("w8_bottomk", "works", f"WITH {_DRAW} SELECT field, year, CAST(bin AS INTEGER) AS bin, count(*) AS drawn, min(wid) AS least FROM drawn WHERE draw = 20260803 GROUP BY ALL")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir)[0].where(F.col("draw") == DRAWS[1]).groupBy("field", "year", "bin").agg(F.count("*").alias("drawn"), F.min("wid").alias("least"))


@registry("m3_overlap", "works", f"WITH {_DRAW} SELECT CAST(a.draw AS INTEGER) AS a, CAST(b.draw AS INTEGER) AS b, count(*) AS both FROM drawn a JOIN drawn b ON a.wid = b.wid AND a.draw < b.draw GROUP BY ALL")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.overlap(drawn(spark, sf_dir)[0])


@registry("m3_shortfall", "works", f"WITH {_DRAW}, g AS (SELECT draw, field, year, bin, count(*) AS got FROM drawn GROUP BY ALL), a AS (SELECT * FROM cells, (VALUES (20260802), (20260803), (20260804)) AS d(draw) WHERE quota > 0) SELECT CAST(a.draw AS INTEGER) AS draw, CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(coalesce(got, 0)) AS BIGINT) AS drawn, CAST(sum(quota - coalesce(got, 0)) AS BIGINT) AS short FROM a LEFT JOIN g USING (draw, field, year, bin) GROUP BY a.draw")
def m3_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, cells = drawn(spark, sf_dir)
    return sampling.shortfall(found, cells, DRAWS)


@registry("c5_checksum", "works", f"WITH {_DRAW} SELECT count(*) AS n, sha256(string_agg('W' || wid || chr(10), '' ORDER BY wid)) AS sha256 FROM drawn WHERE draw = 20260802")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.checksum(drawn(spark, sf_dir)[0].where(F.col("draw") == DRAWS[0]), "wid")


@registry("w9_dedup_title", "", "WITH t AS (SELECT doc_id, substr(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\p{M}]+', '', 'g'), 1, 80) AS key, n_chars FROM documents) SELECT key, arg_max(doc_id, n_chars * 1000000 - doc_id) AS doc_id, max(n_chars) AS n_chars FROM t GROUP BY key")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal titles (here: openings of documents) keep the row with the highest score."""
    rows = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", text.title_key(F.col("text")).alias("key"))
    return windows.best_by_key(rows, ["key"], "n_chars", "doc_id")


@registry("w10_auc", "papers", "WITH s AS (SELECT sid % 50 AS score, count(*) FILTER (type = 'article') AS p, count(*) FILTER (type <> 'article') AS q FROM papers GROUP BY 1), b AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s) SELECT round(sum(p * (below + q / 2)) / sum(p) / sum(q), 6) AS auc FROM b")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type") == "article"
    rows = fx.papers(spark, sf_dir).groupBy((F.col("sid") % 50).alias("score")).agg(F.count_if(kind).alias("p"), F.count_if(~kind).alias("q"))
    return windows.auc(rows, "score", "p", "q").select(F.round("auc", 6).alias("auc"))


@registry("t1_global_top", "papers", "SELECT wid, price FROM papers ORDER BY price DESC, wid LIMIT 500")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_k(fx.papers(spark, sf_dir), 500, "price", "wid").select("wid", "price")


@registry("t3_elite", "sources papers", f"WITH {_POOL}, r AS (SELECT *, row_number() OVER (ORDER BY jif DESC, sid) AS k FROM pool) SELECT CAST(e.k AS INTEGER) AS elite, count(*) AS n, round(avg(jif), 4) AS mean_jif FROM r JOIN (VALUES (0), (2000), (1000), (600), (300)) AS e(k) ON e.k = 0 OR r.k <= e.k GROUP BY e.k")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistic for the best by an outside metric, at several sizes (0: all), in one scan."""
    ranked = windows.ordinal(pool(spark, sf_dir), "jif", "sid", "k")
    sizes = (0, 2000, 1000, 600, 300)
    rows = ranked.withColumn("elite", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda e: (e == 0) | (e >= F.col("k")))))
    return rows.groupBy("elite").agg(F.count("*").alias("n"), F.round(F.avg("jif"), 4).alias("mean_jif"))


@registry("t5_release_order", "sources", "SELECT source_id, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN sid % 3 <> 0 THEN 100000 - sid END, 2147483647), sid) AS INTEGER) AS place FROM sources")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a released order; those it doesn't know come last, in their own order."""
    rows = fx.sources(spark, sf_dir).select("source_id", "sid")
    released = rows.where("sid % 3 <> 0").select("source_id", (F.lit(100000) - F.col("sid")).alias("ord"))
    from citegrain.operators import release

    return release.in_order(rows, released, "source_id", "sid").select("source_id", "place")


@registry("t6_multi_sort", "papers hops", "SELECT wid, row_number() OVER (ORDER BY (hop IS NOT NULL) DESC, hop NULLS LAST, coalesce(type, ''), wid) AS place FROM papers LEFT JOIN hops ON wid = hops.id")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citegrain.plans.graph_queries import hops

    rows = fx.papers(spark, sf_dir).join(hops(spark, sf_dir).withColumnRenamed("id", "wid"), "wid", "left")
    order = (F.col("hop").isNotNull().desc(), F.asc_nulls_last("hop"), F.coalesce("type", F.lit("")).asc(), F.col("wid").asc())
    return windows.placed(rows.select("wid", "hop", "type"), *order).select("wid", "place")


_TOPS = "WITH " + _POOL + ", a AS (SELECT source_id, total AS v FROM pool ORDER BY total DESC, sid LIMIT {k}), b AS (SELECT source_id, jif AS v FROM pool ORDER BY jif DESC, sid LIMIT {k})"


@registry("x1_overlap", "sources papers", " UNION ALL ".join(f"SELECT {k} AS k, (SELECT count(*) FROM (SELECT source_id FROM (SELECT source_id FROM pool ORDER BY total DESC, sid LIMIT {k}) INTERSECT SELECT source_id FROM (SELECT source_id FROM pool ORDER BY jif DESC, sid LIMIT {k}))) AS overlap" for k in (20, 100, 1000)).join(["WITH " + _POOL + " ", ""]))
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(pool(spark, sf_dir), "pool")
    parts = [windows.top_k(rows, k, "total", "sid").select("source_id").intersect(windows.top_k(rows, k, "jif", "sid").select("source_id")).agg(F.lit(k).alias("k"), F.count("*").alias("overlap")) for k in (20, 100, 1000)]
    return reduce(DataFrame.unionByName, parts)


@registry("x2_union_inter", "sources papers", _TOPS.format(k=200) + ", u AS (SELECT source_id FROM a UNION SELECT source_id FROM b), i AS (SELECT source_id FROM a INTERSECT SELECT source_id FROM b) SELECT 'union' AS which, count(*) AS n, round(corr(total, jif), 4) AS r FROM pool WHERE source_id IN (SELECT source_id FROM u) UNION ALL SELECT 'intersection', count(*), round(corr(total, jif), 4) FROM pool WHERE source_id IN (SELECT source_id FROM i)")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(pool(spark, sf_dir), "pool")
    a, b = (windows.top_k(rows, 200, m, "sid").select("source_id") for m in ("total", "jif"))
    out = [rows.join(s, "source_id", "left_semi").agg(F.lit(name).alias("which"), F.count("*").alias("n"), F.round(F.corr("total", "jif"), 4).alias("r")) for name, s in (("union", a.union(b).distinct()), ("intersection", a.intersect(b)))]
    return reduce(DataFrame.unionByName, out)


@registry("x3_membership", "sources papers", f"WITH {_POOL}, t AS (SELECT source_id, 'total' AS d FROM (SELECT * FROM pool ORDER BY total DESC, sid LIMIT 20) UNION ALL SELECT source_id, 'jif' FROM (SELECT * FROM pool ORDER BY jif DESC, sid LIMIT 20) UNION ALL SELECT source_id, 'n' FROM (SELECT * FROM pool ORDER BY n DESC, sid LIMIT 20)) SELECT source_id, count(*) AS n_lists, string_agg(d, ',' ORDER BY d) AS lists FROM t GROUP BY source_id")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of several top lists, with the lists each member is in."""
    rows = written(pool(spark, sf_dir), "pool")
    tops = [windows.top_k(rows, 20, m, "sid").select("source_id", F.lit(m).alias("d")) for m in ("total", "jif", "n")]
    return reduce(DataFrame.unionByName, tops).groupBy("source_id").agg(F.count("*").alias("n_lists"), F.array_join(F.array_sort(F.collect_list("d")), ",").alias("lists"))


@registry("x4_symdiff", "papers", "SELECT (SELECT count(*) FROM papers WHERE priority = '1-URGENT' AND type <> 'article') AS only_left, (SELECT count(*) FROM papers WHERE priority <> '1-URGENT' AND type = 'article') AS only_right")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.papers(spark, sf_dir)
    return contracts.symmetric_difference(rows.where("priority = '1-URGENT'"), rows.where("type = 'article'"), "wid")


@registry("x8_universe", "papers", "WITH a AS (SELECT sid, sum(price) FILTER (type = 'article') AS x, sum(price) FILTER (priority = '1-URGENT') AS y FROM papers GROUP BY sid), b AS (SELECT *, coalesce(x, 0) > 0 AS p, coalesce(y, 0) > 0 AS q FROM a) SELECT count(*) AS all_venues, count(*) FILTER (p OR q) AS union_nonzero, count(*) FILTER (p AND q) AS inter_nonzero FROM b")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universes of venues: all, those with a score under either definition, those with both."""
    rows = fx.papers(spark, sf_dir)
    x, y = (rows.groupBy("sid").agg(F.sum(F.when(c, F.col("price"))).alias(n)) for c, n in ((F.col("type") == "article", "x"), (F.col("priority") == "1-URGENT", "y")))
    both = x.join(y, "sid", "full").select((F.coalesce("x", F.lit(0.0)) > 0).alias("p"), (F.coalesce("y", F.lit(0.0)) > 0).alias("q"))
    return both.agg(F.count("*").alias("all_venues"), F.count_if(F.col("p") | F.col("q")).alias("union_nonzero"), F.count_if(F.col("p") & F.col("q")).alias("inter_nonzero"))
