"""Queries of linkage and seed flags: 2.J, 2.D and parts of 2.A and 2.C of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain import storage
from citegrain.functions import ids, values
from citegrain.operators import contracts, graph, metrics, release, seeds
from citegrain.plans import fixtures as fx
from citegrain.plans.registry import Registry

registry = Registry()


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.linkage(fx.assignees(spark, sf_dir), fx.pairs(spark, sf_dir))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = seeds.seed_index(triplets(spark, sf_dir), fx.universities(spark, sf_dir))
    return seeds.seed_flags(index, fx.papers(spark, sf_dir))


@registry("j1_linkage", "triplets", "SELECT patent_id, assignee_id, univ_hospital_gov, founding_year, round(founding_score, 6) AS founding_score, paperid, patent, daysdiffcont, us_patent_id FROM triplets")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).withColumn("founding_score", F.round("founding_score", 6))


@registry("j2_first_match", "papers pairs", "WITH f AS (SELECT paperid, arg_min(patent, patent) AS patent, min(daysdiffcont) FILTER (k = 1) AS days FROM (SELECT *, row_number() OVER (PARTITION BY paperid ORDER BY patent, daysdiffcont) AS k FROM pairs) GROUP BY paperid) SELECT p.id, f.patent, f.days, f.paperid IS NOT NULL AS linked FROM papers p LEFT JOIN f ON p.id = f.paperid")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = fx.pairs(spark, sf_dir).withColumnsRenamed({"paperid": "id", "daysdiffcont": "days"})
    return seeds.first_match(fx.papers(spark, sf_dir).select("id"), right, "id", ["patent", "days"], "linked").select("id", "patent", "days", "linked")


@registry("j3_all_match", "papers pairs", "WITH m AS (SELECT paperid, string_agg(patent || ':' || daysdiffcont, ',' ORDER BY patent, daysdiffcont) AS links FROM pairs GROUP BY paperid), k AS (SELECT id, CASE WHEN wid % 5 <> 0 THEN id END AS mag FROM papers) SELECT k.id, m.links, CASE WHEN k.mag IS NOT NULL THEN m.links IS NOT NULL END AS cited FROM k LEFT JOIN m ON k.mag = m.paperid")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a paper; the flag is three-valued, as papers without the key can't be linked."""
    left = fx.papers(spark, sf_dir).select("id", F.when(F.col("wid") % 5 != 0, F.col("id")).alias("mag"))
    out = seeds.all_matches(left, fx.pairs(spark, sf_dir).withColumnRenamed("paperid", "mag"), "mag", ["patent", "daysdiffcont"], "links", "cited")
    joined = F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["patent"], x["daysdiffcont"].cast("string"))), ",")
    return out.select("id", joined.alias("links"), "cited")


@registry("j4_edges", "edges papers", "SELECT DISTINCT e.src, e.dst FROM edges e JOIN papers a ON e.src = a.wid JOIN papers b ON e.dst = b.wid WHERE a.type <> 'preprint' AND b.type <> 'preprint'")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from arrays of references, distinct, where both ends exist."""
    refs = fx.edges(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("refs"))
    nodes = fx.papers(spark, sf_dir).where("type <> 'preprint'").select(F.col("wid").alias("id"))
    return graph.clean_edges(graph.cited_edges(refs), nodes)


@registry("j5_merged_delete", "papers", "WITH m AS (SELECT wid AS id, CASE WHEN wid % 20 = 0 THEN wid + 1 ELSE -1 END AS into_id FROM papers WHERE wid % 10 = 0) SELECT wid FROM papers WHERE wid NOT IN (SELECT id FROM m WHERE into_id IN (SELECT wid FROM papers))")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged ids go, but only if what they were merged into exists."""
    works = fx.papers(spark, sf_dir).select("wid")
    merged = works.where("wid % 10 = 0").select(F.col("wid").alias("id"), F.when(F.col("wid") % 20 == 0, F.col("wid") + 1).otherwise(-1).alias("into_id"))
    gone = merged.join(works, F.col("into_id") == F.col("wid"), "left_semi").select(F.col("id").alias("wid"))
    return works.join(gone, "wid", "left_anti")


@registry("j8_date_lookup", "triplets papers", "WITH s AS (SELECT DISTINCT paperid FROM triplets) SELECT CAST(year(w.publication_date) AS INTEGER) AS year, count(*) AS papers, (SELECT count(*) FROM s WHERE paperid NOT IN (SELECT id FROM papers WHERE wid % 9 <> 0)) AS unmatched FROM s JOIN papers w ON s.paperid = w.id WHERE w.wid % 9 <> 0 GROUP BY 1")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the linked papers; those that aren't found are dropped and counted."""
    linked = triplets(spark, sf_dir).select(F.col("paperid").alias("id")).distinct()
    known = fx.papers(spark, sf_dir).where("wid % 9 <> 0").select("id", "publication_date")
    unmatched = contracts.outside(linked, known).agg(F.count("*").alias("unmatched"))
    return linked.join(known, "id").groupBy(F.year("publication_date").alias("year")).agg(F.count("*").alias("papers")).join(F.broadcast(unmatched))


@registry("j9_preflight", "", "WITH i AS (SELECT o_orderkey AS k FROM orders UNION SELECT -1) SELECT k AS id, count(l_orderkey) AS n FROM i LEFT JOIN lineitem ON k = l_orderkey GROUP BY k HAVING count(l_orderkey) <> 1")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that don't have exactly one row."""
    asked = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("id")))
    return contracts.membership(asked, fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@registry("j10_names", "sources", "SELECT s.source_id, coalesce(nullif(CASE WHEN s.sid % 3 = 0 THEN '' WHEN s.sid % 3 = 1 THEN s.source_name END, ''), upper(s.source_name)) AS source_name FROM sources s")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are looked up only where they are missing or blank."""
    rows = fx.sources(spark, sf_dir)
    have = rows.select("source_id", F.when(F.col("sid") % 3 == 0, "").when(F.col("sid") % 3 == 1, F.col("source_name")).alias("name"))
    return metrics.with_names(have, rows.select("source_id", F.upper("source_name").alias("lookup")))


@registry("j11_either_id", "papers sources", "SELECT p.wid, s.source_name FROM papers p LEFT JOIN sources s ON p.sid = s.sid")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare and full ids meet: both sides are normalised, then joined once."""
    left = fx.papers(spark, sf_dir).select("wid", F.when(F.col("wid") % 2 == 0, ids.full_id(F.col("source_id"))).otherwise(F.col("source_id")).alias("ref"))
    right = fx.sources(spark, sf_dir).select(F.when(F.col("sid") % 3 == 0, ids.full_id(F.col("source_id"))).otherwise(F.col("source_id")).alias("key"), "source_name")
    return left.withColumn("k", ids.bare_id(F.col("ref"))).join(right.withColumn("k", ids.bare_id(F.col("key"))), "k", "left").select("wid", "source_name")


@registry("j12_release", "sources papers", "SELECT s.source_id, coalesce(a.n, 0) AS articles_n, coalesce(round(a.t, 2), 0) AS articles_t, coalesce(b.n, 0) AS urgent_n FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n, sum(price) AS t FROM papers WHERE type = 'article' GROUP BY source_id) a USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM papers WHERE priority = '1-URGENT' GROUP BY source_id) b USING (source_id)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = fx.papers(spark, sf_dir)
    parts = {
        "articles": papers.where("type = 'article'").groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("t")),
        "urgent": papers.where("priority = '1-URGENT'").groupBy("source_id").agg(F.count("*").alias("n")),
    }
    return release.assembled(fx.sources(spark, sf_dir).select("source_id"), parts)


@registry("j13_basis", "sources papers", "WITH b AS (SELECT source_id, count(*) AS works, round(sum(price), 6) AS total, count(*) FILTER (type = 'article') AS articles FROM papers GROUP BY source_id) SELECT s.source_id, coalesce(works, 0) AS works, round(CASE WHEN works > 0 THEN round(total, 6) / works ELSE 0 END, 6) AS norm, round(articles / nullif(works, 0)::DOUBLE, 4) AS article_share FROM sources s LEFT JOIN b USING (source_id)")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basis table: totals over works from rounded totals, shares blank without works."""
    rows = fx.papers(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("works"), F.sum("price").alias("total"), F.count_if(F.col("type") == "article").alias("articles"))
    out = fx.sources(spark, sf_dir).select("source_id").join(rows, "source_id", "left").withColumn("works", F.coalesce("works", F.lit(0)))
    return out.select("source_id", "works", F.round(release.per_work(F.col("total"), F.col("works")), 6).alias("norm"), F.round(release.share(F.col("articles"), F.col("works")), 4).alias("article_share"))


def issn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside list: titles with two ISSNs (one of another journal) and a metric."""
    key = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    other = F.lpad((F.col("p_partkey") / 2).cast("bigint").cast("string"), 8, "0")
    form = lambda k: F.concat(F.substring(k, 1, 4), F.lit("-"), F.substring(k, 5, 4))
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.concat_ws(",", form(key), form(other)).alias("issns"), F.col("p_retailprice").cast("string").alias("metric"))


_ISSN = """rows AS (SELECT p_partkey AS ord, p_name AS title, p_retailprice AS metric, unnest([lpad(CAST(p_partkey AS VARCHAR), 8, '0'), lpad(CAST(p_partkey // 2 AS VARCHAR), 8, '0')]) AS issn FROM part),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issn ORDER BY metric DESC, ord) AS k FROM (SELECT DISTINCT * FROM rows)) WHERE k = 1)"""


@registry("j15_issn_map", "", f"WITH {_ISSN} SELECT issn, title, metric FROM best")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.issn_map(issn_rows(spark, sf_dir), values.number).select("issn", "title", "metric")


@registry("j14_issn_max", "sources", f"WITH {_ISSN}, s AS (SELECT source_id, unnest([lpad(CAST(sid AS VARCHAR), 8, '0'), lpad(CAST(sid + 7 AS VARCHAR), 8, '0')]) AS issn FROM sources), m AS (SELECT s.source_id, b.*, row_number() OVER (PARTITION BY s.source_id ORDER BY metric DESC, s.issn) AS j FROM s JOIN best b ON s.issn = b.issn) SELECT q.source_id, m.title, m.metric FROM (SELECT DISTINCT source_id FROM s) q LEFT JOIN (SELECT * FROM m WHERE j = 1) m ON q.source_id = m.source_id")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each venue gets the whole row of its ISSN with the highest metric."""
    rows = fx.sources(spark, sf_dir)
    key = F.lpad((F.col("sid") + 7).cast("string"), 8, "0")
    venues = rows.select("source_id", F.array("issn", F.lower(key)).alias("issns"))
    return metrics.matched(venues, metrics.issn_map(issn_rows(spark, sf_dir), values.number)).select("source_id", "title", "metric")


@registry("j16_drop_reasons", "sources papers", "WITH j AS (SELECT s.sid, s.jif, p.n FROM sources s LEFT JOIN (SELECT sid, count(*) AS n FROM papers GROUP BY sid) p ON s.sid = p.sid) SELECT count(*) AS rows, count(*) FILTER (n IS NULL) AS no_papers, count(*) FILTER (n IS NOT NULL AND jif IS NULL) AS no_metric, count(*) FILTER (n IS NOT NULL AND jif IS NOT NULL) AS kept FROM j")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.papers(spark, sf_dir).groupBy("sid").agg(F.count("*").alias("n"))
    rows = fx.sources(spark, sf_dir).select("sid", "jif").join(own, "sid", "left")
    n, jif = F.col("n").isNotNull(), F.col("jif").isNotNull()
    return rows.agg(F.count("*").alias("rows"), F.count_if(~n).alias("no_papers"), F.count_if(n & ~jif).alias("no_metric"), F.count_if(n & jif).alias("kept"))


@registry("j17_funders", "", "WITH g AS (SELECT o_orderkey AS wid, unnest([o_custkey % 10, o_custkey % 7]) AS f, unnest([0, 1]) AS k FROM orders) SELECT wid, string_agg(CASE WHEN f % 2 = 0 THEN 'private_' ELSE 'public_' END || f, '|' ORDER BY k) AS classes, bool_or(f % 2 = 0) AS has_private, bool_or(f % 2 = 1) AS has_public FROM g GROUP BY wid")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funders by bare or full id, looked up in place, and what classes occur."""
    k = F.col("o_custkey")
    grants = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("wid"), F.array(ids.full_id(F.concat(F.lit("F"), (k % 10).cast("string"))), F.concat(F.lit("F"), (k % 7).cast("string"))).alias("funders"))
    known = spark.range(10).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("id"), F.concat(F.when(F.col("id") % 2 == 0, "private_").otherwise("public_"), F.col("id").cast("string")).alias("class"))
    out = metrics.looked_up(grants, "wid", "funders", known, "id", "class", "classes")
    return out.select("wid", F.array_join("classes", "|").alias("classes"), values.any_prefix(F.col("classes"), "private_").alias("has_private"), values.any_prefix(F.col("classes"), "public_").alias("has_public"))


@registry("j18_top_fields", "papers", "WITH t AS (SELECT field FROM papers GROUP BY field ORDER BY count(*) DESC, field LIMIT 10) SELECT p.field, count(*) AS n FROM papers p JOIN t USING (field) GROUP BY p.field")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.papers(spark, sf_dir)
    top = rows.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(10)
    return rows.join(F.broadcast(top.select("field")), "field", "left_semi").groupBy("field").agg(F.count("*").alias("n"))


@registry("a1_seed_index", "flags triplets papers", "SELECT f.paperid, f.corporate, f.university, (SELECT count(DISTINCT (t.daysdiffcont, t.founding_year)) FROM triplets t WHERE t.paperid = f.paperid AND TRY_CAST(t.univ_hospital_gov AS DOUBLE) = 0 AND t.founding_score >= 8.0) AS candidates FROM flags f")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seeds.seed_index(triplets(spark, sf_dir), fx.universities(spark, sf_dir))
    return out.select("paperid", "corporate", "university", F.size("candidates").cast("bigint").alias("candidates"))


@registry("a2_univ_conflict", "universities", "WITH r AS (SELECT assignee_id, university FROM universities UNION ALL SELECT assignee_id, '1' FROM universities WHERE CAST(assignee_id AS INTEGER) % 10 = 0) SELECT assignee_id, bool_or(university = '1') AS university, min(university) <> max(university) AS conflict FROM r GROUP BY assignee_id")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.universities(spark, sf_dir)
    more = rows.where(F.col("assignee_id").cast("int") % 10 == 0).select("assignee_id", F.lit("1").alias("university"))
    return seeds.university_flags(rows.unionByName(more))


@registry("d1_d4_seed_flags", "flags", "SELECT paperid AS id, true AS all_assignees, corporate, young AS young_firm, young OR university AS young_firm_university FROM flags")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir)


@registry("d3_young_firm", "flags", "SELECT paperid AS id FROM flags WHERE young")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where("young_firm").select("id")


@registry("d4_sparse", "flags papers", "SELECT p.id, CASE WHEN f.corporate THEN true END AS corporate, CASE WHEN f.young THEN true END AS young_firm FROM papers p LEFT JOIN flags f ON p.id = f.paperid")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags as sparse properties: true or absent."""
    out = fx.papers(spark, sf_dir).select("id").join(flags(spark, sf_dir), "id", "left")
    return out.select("id", seeds.sparse(F.col("corporate")).alias("corporate"), seeds.sparse(F.col("young_firm")).alias("young_firm"))


@registry("d5_override", "flags papers", "SELECT p.id, CASE WHEN f.paperid IS NOT NULL AND f.corporate THEN true END AS corporate FROM papers p LEFT JOIN flags f ON p.id = f.paperid")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags derived from the index replace stored ones wherever there is an index."""
    stored = fx.papers(spark, sf_dir).select("id", F.lit(True).alias("stored"))
    index = flags(spark, sf_dir).where("corporate").select("id")
    return contracts.sparse_patch(stored, index, "corporate").select("id", "corporate")


@registry("x6_invariants", "flags", "SELECT 'corporate in all' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'young in corporate', count(*) FILTER (young AND NOT corporate) FROM flags UNION ALL SELECT 'young in young or university', CAST(0 AS BIGINT) UNION ALL SELECT 'young or university in corporate', count(*) FILTER ((young OR university) AND NOT corporate) FROM flags")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which seed sets contain which; the last rule doesn't hold and is counted."""
    c = F.col
    rules = [
        ("corporate in all", c("corporate"), c("all_assignees")),
        ("young in corporate", c("young_firm"), c("corporate")),
        ("young in young or university", c("young_firm"), c("young_firm_university")),
        ("young or university in corporate", c("young_firm_university"), c("corporate")),
    ]
    return contracts.subset_violations(flags(spark, sf_dir), rules)


@registry("c3_sparse_patch", "papers", "SELECT count(*) AS papers, count(*) FILTER (wid % 11 = 0) AS is_true, CAST(0 AS BIGINT) AS is_false, true AS first, false AS second, true AS forced FROM papers")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch sets a property for exactly these ids and is verified; done twice it is left out, unless
    forced."""
    rows = fx.papers(spark, sf_dir).select(F.col("wid").alias("id"))
    members = rows.where("id % 11 = 0")
    once, first = contracts.patched(contracts.sparse_patch(rows, rows, "flag"), members, "flag")
    twice, second = contracts.patched(once, members, "flag")
    again, forced = contracts.patched(twice, members, "flag", force=True)
    said = [F.lit(x).alias(n) for n, x in (("first", first), ("second", second), ("forced", forced))]
    return again.agg(F.count("*").alias("papers"), F.count_if("flag").alias("is_true"), F.count_if(~F.col("flag")).alias("is_false"), *said)


@registry("c9_partial_failures", "papers", "SELECT field AS batch, count(*) AS total, count(*) FILTER (wid % 400 <> 3) AS committed, count(*) FILTER (wid % 400 = 3) AS failed FROM papers GROUP BY field HAVING count(*) FILTER (wid % 400 = 3) > 0")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of which some rows failed; a run with any is refused."""
    bad = F.col("wid") % 400 == 3
    summary = fx.papers(spark, sf_dir).groupBy(F.col("field").alias("batch")).agg(F.count("*").alias("total"), F.count_if(~bad).alias("committed"), F.count_if(bad).alias("failed"), F.array_compact(F.collect_set(F.when(bad, F.lit("timeout")))).alias("errors"))
    return contracts.partial_failures(summary).drop("errors")


@registry("s21_reset", "papers", "SELECT wid AS id FROM papers WHERE type <> 'preprint'")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph is emptied and filled again; what was there before is gone."""
    path = storage.new_path(spark, "graph")
    rows = fx.papers(spark, sf_dir).select(F.col("wid").alias("id"), "type")
    rows.write.parquet(path)
    storage.remove(spark, path)
    rows.where("type <> 'preprint'").write.parquet(path)
    return spark.read.parquet(path).select("id")


@registry("c4_seed_counts", "flags", "SELECT count(*) AS all_assignees, count(*) FILTER (corporate) AS corporate, count(*) FILTER (young) AS young_firm, count(*) FILTER (young OR university) AS young_firm_university FROM flags")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("all_assignees", "corporate", "young_firm", "young_firm_university")
    return flags(spark, sf_dir).agg(*[F.count_if(n).alias(n) for n in names])


@registry("a24_coverage", "sources", "SELECT count(*) AS venues, count(jif) AS with_jif, count(*) FILTER (source_type IN ('j', 'c')) AS typed, count(jif) FILTER (source_type IN ('j', 'c')) AS typed_with_jif FROM sources")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.col("source_type").isin("j", "c")
    return fx.sources(spark, sf_dir).agg(F.count("*").alias("venues"), F.count("jif").alias("with_jif"), F.count_if(typed).alias("typed"), F.count_if(typed & F.col("jif").isNotNull()).alias("typed_with_jif"))


@registry("s19_upsert", "", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of nodes: one row a key, the last write wins."""
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey")
    return fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(order).alias("last")).select("l_orderkey", "l_linenumber", "last.l_partkey")
