"""Stand-ins for works, citations, seeds and venues over the star-schema test tables, and the same
views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), distinct: an order cites its customer's two before, and the last one before by key
    that shares a part if its own key is a multiple of seven."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = orders.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey", 1).over(by_date).alias("one"), F.lag("o_orderkey", 2).over(by_date).alias("two"))
    own = own.select("src", F.explode(F.array("one", "two")).alias("dst"))
    parts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    shared = parts.select(F.col("l_orderkey").alias("src"), F.lag("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey")).alias("dst")).where("src % 7 = 0")
    return own.unionByName(shared).where("dst IS NOT NULL").distinct()


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = edges(spark, sf_dir).groupBy(F.col("dst").alias("wid")).agg(F.count("*").alias("cited_by_count"))
    return papers(spark, sf_dir).join(cited, "wid", "left").withColumn("cited_by_count", F.coalesce("cited_by_count", F.lit(0)))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """works without cited_by_count, which needs the edges."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("wid"),
        F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("id"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.year("o_orderdate").alias("publication_year"),
        F.when(F.col("o_orderstatus") == "F", "article").when(F.col("o_orderstatus") == "O", "book-chapter").otherwise("preprint").alias("type"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.col("o_custkey").alias("sid"),
        (F.col("o_orderkey") % 26 + 11).cast("int").alias("field"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_custkey % 50 = 0").select(F.col("o_orderkey").alias("id"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    jif = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 100)
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("source_id"),
        F.col("c_custkey").alias("sid"),
        F.col("c_name").alias("source_name"),
        F.when(segment == "BUILDING", "c").when(segment == "FURNITURE", "r").when(segment == "HOUSEHOLD", "b").otherwise("j").alias("source_type"),
        jif.alias("jif"),
        F.concat(F.substring(key, 1, 4), F.lit("-"), F.substring(key, 5, 4)).alias("issn"),
    )


def assignees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("patent_id"),
        F.col("s_suppkey").cast("string").alias("assignee_id"),
        F.when(F.col("s_nationkey") % 3 == 0, "1").when(F.col("s_nationkey") % 3 == 1, "0").alias("univ_hospital_gov"),
        (F.col("s_suppkey") % 8 + 1990).cast("int").alias("founding_year"),
        (F.col("s_acctbal") / 1000).alias("founding_score"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R' AND l_discount > 0.08")
        .select(F.concat(F.lit("W"), F.col("l_orderkey").cast("string")).alias("paperid"), F.concat(F.lit("US-"), F.col("l_suppkey").cast("string")).alias("patent"), (F.col("l_quantity") * 20).cast("int").alias("daysdiffcont"))
        .distinct()
    )


def universities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("assignee_id"), (F.col("s_suppkey") % 2).cast("string").alias("university"))


#: The same as common table expressions.
SQL = {
    "edges": """SELECT DISTINCT src, dst FROM (
  SELECT o_orderkey AS src, unnest([lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w]) AS dst FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  UNION ALL
  SELECT src, dst FROM (SELECT l_orderkey AS src, lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS dst FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE src % 7 = 0
) WHERE dst IS NOT NULL""",
    "papers": """SELECT o_orderkey AS wid, concat('W', o_orderkey) AS id, CAST(o_orderdate AS DATE) AS publication_date, CAST(year(o_orderdate) AS INTEGER) AS publication_year,
  CASE o_orderstatus WHEN 'F' THEN 'article' WHEN 'O' THEN 'book-chapter' ELSE 'preprint' END AS type, concat('S', o_custkey) AS source_id, o_custkey AS sid,
  CAST(o_orderkey % 26 + 11 AS INTEGER) AS field, o_totalprice AS price, o_orderpriority AS priority FROM orders""",
    "works": "SELECT p.*, coalesce(c.n, 0) AS cited_by_count FROM papers p LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) c ON p.wid = c.dst",
    "seeds": "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 50 = 0",
    "sources": """SELECT concat('S', c_custkey) AS source_id, c_custkey AS sid, c_name AS source_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'c' WHEN 'FURNITURE' THEN 'r' WHEN 'HOUSEHOLD' THEN 'b' ELSE 'j' END AS source_type,
  CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 END AS jif, substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 1, 4) || '-' || substr(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 5, 4) AS issn FROM customer""",
    "assignees": """SELECT CAST(s_suppkey AS VARCHAR) AS patent_id, CAST(s_suppkey AS VARCHAR) AS assignee_id, CASE s_nationkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS univ_hospital_gov,
  CAST(s_suppkey % 8 + 1990 AS INTEGER) AS founding_year, s_acctbal / 1000 AS founding_score FROM supplier""",
    "pairs": "SELECT DISTINCT concat('W', l_orderkey) AS paperid, concat('US-', l_suppkey) AS patent, CAST(l_quantity * 20 AS INTEGER) AS daysdiffcont FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08",
    "universities": "SELECT CAST(s_suppkey AS VARCHAR) AS assignee_id, CAST(s_suppkey % 2 AS VARCHAR) AS university FROM supplier",
    "triplets": "SELECT a.*, p.*, replace(p.patent, 'US-', '') AS us_patent_id FROM assignees a JOIN pairs p ON a.patent_id = replace(p.patent, 'US-', '')",
    "flags": """SELECT t.paperid,
    bool_or(coalesce(TRY_CAST(univ_hospital_gov AS DOUBLE) = 0, false)) AS corporate,
    bool_or(coalesce(u.university = '1' AND TRY_CAST(univ_hospital_gov AS DOUBLE) = 1, false)) AS university,
    bool_or(coalesce(TRY_CAST(univ_hospital_gov AS DOUBLE) = 0 AND founding_score >= 8.0 AND year(w.publication_date + daysdiffcont) - founding_year BETWEEN 0 AND 3, false)) AS young
  FROM triplets t LEFT JOIN universities u ON t.assignee_id = u.assignee_id LEFT JOIN papers w ON t.paperid = w.id GROUP BY t.paperid""",
    "hops": "SELECT id, hop FROM walk",
}
_NEEDS = {"works": ["papers", "edges"], "triplets": ["assignees", "pairs"], "flags": ["triplets", "universities", "papers"], "hops": ["edges", "seeds"]}


def walk_sql(name: str, start: str, edges: str = "edges", a: str = "src", b: str = "dst") -> str:
    """A walk from a start (id, 0) along edges, as far as it goes; an id is found once, at its least hop."""
    return f"{name}(id, hop) USING KEY (id) AS ({start} UNION SELECT e.{b}, w.hop + 1 FROM {name} w JOIN {edges} e ON w.id = e.{a} WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.id = e.{b}))"


def sql(names: str, body: str) -> str:
    """body after the named views and what they need; `hops` brings a recursive walk along edges."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = []
    for name in order:
        if name == "hops":
            parts.append(walk_sql("walk", "SELECT id, 0 FROM seeds"))
        parts.append(f"{name} AS ({SQL[name]})" if name not in ("edges", "triplets", "flags") else f"{name} AS MATERIALIZED ({SQL[name]})")
    if not parts:
        return body
    tail = body.strip()
    tail = ", " + tail[5:] if tail.upper().startswith("WITH ") else tail
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + tail
