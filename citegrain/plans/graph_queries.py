"""Queries of reachability and rank: 2.G of the survey, with the rules that guard them (2.C, 2.X)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain import storage
from citegrain.operators import contracts, graph
from citegrain.plans import fixtures as fx
from citegrain.plans.registry import Registry
from citegrain.storage import written

registry = Registry()

SEED_SETS = {"urgent": "1-URGENT", "high": "2-HIGH"}


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hops from the seeds: a table kept under the state of the files that they come from."""
    key = storage.version(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet")
    return storage.cached(spark, "hops", key, lambda: graph.bfs_hops(fx.edges(spark, sf_dir), fx.seeds(spark, sf_dir)))


def projected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reached papers and the edges among them. A node that is reached has only reached targets, so
    only the sources of edges need a test."""
    nodes = hops(spark, sf_dir)
    return nodes, graph.clean_edges(fx.edges(spark, sf_dir), nodes)


def ranked(spark: SparkSession, sf_dir: str, damping: float = 0.85) -> DataFrame:
    nodes, edges = projected(spark, sf_dir)
    return graph.article_rank(nodes, edges, {"score": F.col("hop") == 0}, damping)


def rank_sql(damping: float = 0.85, steps: int = 20, seeds: str = "hop = 0", name: str = "r") -> str:
    """A chain of materialised steps; their last is {name}{steps}. Needs the view hops."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT id, CASE WHEN {seeds} THEN {1 - damping!r}::DOUBLE ELSE 0.0::DOUBLE END AS b, CASE WHEN {seeds} THEN {1 - damping!r}::DOUBLE ELSE 0.0::DOUBLE END AS r FROM hops)"]
    for i in range(steps):
        parts.append(f"{name}{i + 1} AS MATERIALIZED (SELECT n.id, n.b, n.b + coalesce(s.x, 0.0) AS r FROM {name}{i} n LEFT JOIN (SELECT e.dst, sum({damping}::DOUBLE * p.r / (d.deg + m.mean)) AS x FROM pe e JOIN {name}{i} p ON e.src = p.id JOIN deg d ON e.src = d.src CROSS JOIN m GROUP BY e.dst) s ON n.id = s.dst)")
    return ",\n".join(parts)


RANK_VIEWS = """pe AS MATERIALIZED (SELECT e.* FROM edges e WHERE src IN (SELECT id FROM hops) AND dst IN (SELECT id FROM hops)),
deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM pe GROUP BY src),
m AS (SELECT (SELECT count(*) FROM pe) / (SELECT count(*) FROM hops)::DOUBLE AS mean)"""


@registry("g1_bfs", "hops", "SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs_hops(fx.edges(spark, sf_dir), fx.seeds(spark, sf_dir))


@registry("g4_anchor", "hops", "SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anchor_hops(fx.edges(spark, sf_dir), fx.seeds(spark, sf_dir))


@registry("g5_bounded", "edges", "WITH s AS (SELECT max(src) AS id FROM edges), a AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN s ON e.src = s.id), b AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN a ON e.src = a.id), c AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN b ON e.src = b.id) SELECT id, CAST(min(h) AS INTEGER) AS hop FROM (SELECT id, 1 AS h FROM a UNION ALL SELECT id, 2 FROM b UNION ALL SELECT id, 3 FROM c) WHERE id NOT IN (SELECT id FROM s) GROUP BY id")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one seed up to three hops, without the seed."""
    edges = fx.edges(spark, sf_dir)
    one = edges.agg(F.max("src").alias("id"))
    return graph.expand(edges, one, 3).where("hop > 0")


@registry("g6_resumed", "hops", "SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk of two hops, then its continuation from what it found: the same as one walk."""
    edges, seeds = fx.edges(spark, sf_dir), fx.seeds(spark, sf_dir)
    return graph.bfs_hops(edges, seeds, known=graph.bfs_hops(edges, seeds, 2))


@registry("g7_project", "hops papers", "SELECT p.publication_year, count(DISTINCT p.wid) AS nodes, CAST(count(e.src) AS BIGINT) AS edges FROM papers p JOIN hops h ON p.wid = h.id LEFT JOIN (SELECT e.* FROM edges e JOIN papers a ON e.src = a.wid JOIN papers b ON e.dst = b.wid WHERE a.publication_year BETWEEN 1997 AND 2000 AND b.publication_year BETWEEN 1997 AND 2000 AND a.wid IN (SELECT id FROM hops) AND b.wid IN (SELECT id FROM hops)) e ON p.wid = e.src WHERE p.publication_year BETWEEN 1997 AND 2000 GROUP BY p.publication_year")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of reached papers of some years; nodes and edges by the citing year."""
    nodes = fx.papers(spark, sf_dir).select(F.col("wid").alias("id"), "publication_year").join(hops(spark, sf_dir), "id", "left")
    kept, edges = graph.project(nodes, fx.edges(spark, sf_dir), F.col("hop") >= 0, "publication_year", 1997, 2000)
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return kept.join(out, "id", "left").groupBy("publication_year").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


@registry("g8_labels", "papers edges", "SELECT a.type AS src_type, b.type AS dst_type, count(*) AS edges FROM edges e JOIN papers a ON e.src = a.wid JOIN papers b ON e.dst = b.wid WHERE a.type IN ('article', 'preprint') AND b.type IN ('article', 'preprint') GROUP BY 1, 2")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of a union of labels."""
    nodes = fx.papers(spark, sf_dir).select(F.col("wid").alias("id"), "type")
    kept, edges = graph.project(nodes, fx.edges(spark, sf_dir), F.col("type").isin("article", "preprint"))
    a, b = kept.select(F.col("id").alias("src"), F.col("type").alias("src_type")), kept.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"))


@registry("g9_par", "hops", f"WITH {RANK_VIEWS}, {rank_sql()} SELECT id, round(r, 6) AS score FROM r20")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@registry("g11_damping", "hops", f"WITH {RANK_VIEWS}, {rank_sql(0.5, name='a')}, {rank_sql(0.95, name='b')} SELECT 0.5::DOUBLE AS damping, round(sum(r), 4) AS total, round(max(r), 6) AS top FROM a20 UNION ALL SELECT 0.95::DOUBLE, round(sum(r), 4), round(max(r), 6) FROM b20")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of dampings over one projection, in one pass over its edges a step."""
    nodes, edges = projected(spark, sf_dir)
    grid = {"a": 0.5, "b": 0.95}
    out = graph.article_rank(nodes, edges, dict.fromkeys(grid, F.col("hop") == 0), grid)
    runs = [out.agg(F.lit(d).alias("damping"), F.round(F.sum(k), 4).alias("total"), F.round(F.max(k), 6).alias("top")) for k, d in grid.items()]
    return reduce(DataFrame.unionByName, runs)


@registry("g9_tolerance", "hops", "WITH " + RANK_VIEWS + ", " + rank_sql(0.5, 40, name="t") + ", d AS (" + " UNION ALL ".join(f"SELECT {i} AS step, max(abs(a.r - b.r)) AS change FROM t{i} a JOIN t{i - 1} b ON a.id = b.id" for i in range(1, 41)) + "), s AS (SELECT min(step) AS step FROM d WHERE change <= 1e-4) SELECT CAST(s.step AS INTEGER) AS steps, true AS settled, round(CASE s.step " + " ".join(f"WHEN {i} THEN (SELECT sum(r) FROM t{i})" for i in range(1, 41)) + " END, 4) AS total FROM s")
def g9_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends when no score changes by more than a tolerance, with the steps it took."""
    nodes, edges = projected(spark, sf_dir)
    run = graph.ranked(nodes, edges, {"score": F.col("hop") == 0}, 0.5, 40, 1e-4)
    return run.scores.agg(F.lit(run.steps).alias("steps"), F.lit(run.settled).alias("settled"), F.round(F.sum("score"), 4).alias("total"))


@registry("g2_hop_step", "papers edges", "WITH f AS (SELECT wid AS id FROM papers WHERE wid % 100 = 0), n AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM f) AND dst NOT IN (SELECT id FROM f)) SELECT id % 4 AS worker, count(*) AS n FROM n GROUP BY 1")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop from a frontier, and how its ids fall to four workers; the exchange by id deals them out."""
    frontier = fx.papers(spark, sf_dir).where("wid % 100 = 0").select(F.col("wid").alias("id"))
    return graph.hop_step(fx.edges(spark, sf_dir), frontier, frontier).groupBy((F.col("id") % 4).alias("worker")).agg(F.count("*").alias("n"))


@registry("g3_coverage", "hops", "SELECT id % 4 AS part, count(*) AS expected, count(*) FILTER (id % 97 <> 0) AS found, count(*) FILTER (id % 97 = 0) AS missing, CAST(0 AS BIGINT) AS extra FROM hops GROUP BY 1")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every part of a divided run is whole: here some ids were lost."""
    every = written(hops(spark, sf_dir), "every")
    return contracts.coverage(every, every.where("id % 97 <> 0"), 4)


@registry("g10_source_nodes", "papers", "SELECT wid AS id FROM papers WHERE priority = '1-URGENT' OR type = 'article' AND wid % 3 = 0")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with one of several properties, each true or absent (F2)."""
    nodes = fx.papers(spark, sf_dir).select(F.col("wid").alias("id"), F.nullif(F.col("priority") == "1-URGENT", F.lit(False)).alias("a"), F.when(F.col("wid") % 3 == 0, F.col("type") == "article").alias("b"))
    return graph.source_nodes(nodes, "a", "b").select("id")


SCALERS = ("minmax", "max", "mean", "log", "center", "stdscore")


@registry("g9_scalers", "", "WITH s AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high, avg(c_acctbal) AS mean, stddev_pop(c_acctbal) AS sd, max(abs(c_acctbal)) AS top FROM customer) SELECT c_custkey, round((c_acctbal - low) / (high - low), 6) AS minmax, round(c_acctbal / top, 6) AS max, round((c_acctbal - mean) / (high - low), 6) AS mean, round(ln(c_acctbal + 1001), 6) AS log, round(c_acctbal - mean, 4) AS center, round((c_acctbal - mean) / sd, 6) AS stdscore FROM customer CROSS JOIN s")
def scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", *[(F.col("c_acctbal") + (1000 if k == "log" else 0)).alias(k) for k in SCALERS])
    for k in SCALERS:
        rows = graph.scaled(rows, k, k)
    return rows.select("c_custkey", *[F.round(k, 4 if k == "center" else 6).alias(k) for k in SCALERS])


@registry("g12_multi_seed", "hops papers", f"WITH {RANK_VIEWS}, {rank_sql(seeds='id IN (SELECT wid FROM papers WHERE priority = ' + chr(39) + '1-URGENT' + chr(39) + ')', name='a')}, {rank_sql(seeds='id IN (SELECT wid FROM papers WHERE priority = ' + chr(39) + '2-HIGH' + chr(39) + ')', name='b')} SELECT a.id, round(a.r, 6) AS urgent, round(b.r, 6) AS high FROM a20 a JOIN b20 b ON a.id = b.id")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sets of seeds on one common graph, in one pass over its edges per step."""
    nodes, edges = projected(spark, sf_dir)
    nodes = nodes.join(fx.papers(spark, sf_dir).select(F.col("wid").alias("id"), "priority"), "id")
    out = graph.article_rank(nodes, edges, {k: F.col("priority") == v for k, v in SEED_SETS.items()})
    return out.select("id", *[F.round(k, 6).alias(k) for k in SEED_SETS])


@registry("g14_source_bfs", "edges papers", "WITH se AS (SELECT DISTINCT a.sid AS src, b.sid AS dst FROM edges e JOIN papers a ON e.src = a.wid JOIN papers b ON e.dst = b.wid), " + fx.walk_sql("w", "SELECT c_custkey, 0 FROM customer WHERE c_custkey % 100 = 0", "se", "dst", "src") + ", f AS (SELECT id, hop FROM w) SELECT c.c_custkey AS id, CAST(f.hop AS INTEGER) AS hop, c.c_name AS source_name FROM customer c LEFT JOIN f ON c.c_custkey = f.id")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues by distance from seed venues to those that cite them, over the contracted graph; the
    unreached have a null distance."""
    groups = fx.papers(spark, sf_dir).select(F.col("wid").alias("id"), F.col("sid").alias("group"))
    between = graph.contract(fx.edges(spark, sf_dir), groups)
    customers = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("source_name"))
    found = graph.bfs_hops(between.select(F.col("dst").alias("src"), F.col("src").alias("dst")), customers.where("id % 100 = 0").select("id"))
    return customers.join(found, "id", "left").select("id", "hop", "source_name").orderBy(F.col("hop").isNull(), "hop", "source_name")


@registry("g15_expand", "edges papers", "WITH b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), s AS (SELECT wid AS id FROM papers WHERE wid % 1000 = 0), x AS (SELECT DISTINCT b.dst AS id FROM b JOIN s ON b.src = s.id), y AS (SELECT DISTINCT b.dst AS id FROM b JOIN x ON b.src = x.id), n AS (SELECT id FROM s UNION SELECT id FROM x UNION SELECT id FROM y) SELECT e.src, e.dst FROM edges e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among what lies within two hops, either way, of some papers."""
    edges = fx.edges(spark, sf_dir)
    near = graph.expand(edges, fx.papers(spark, sf_dir).where("wid % 1000 = 0").select("wid"), 2, "both")
    return graph.clean_edges(edges, near)


@registry("g16_reset", "", "SELECT c_custkey, c_name FROM customer")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops what earlier runs have left: columns of hops and counts, with or without suffixes."""
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(1).alias("corporate_min_hops"), F.lit(1).alias("corporate_min_hops_w"), F.lit(1).alias("corporate_reach_count_d5"), F.lit(1).alias("corporate_min_hops_2020"), F.lit(1).alias("corporate_min_hops_all"))
    return contracts.without_results(rows, "corporate")


@registry("c1_contract", "hops papers", "SELECT CAST(count(*) AS BIGINT) AS outside FROM papers WHERE priority = '2-HIGH' AND wid NOT IN (SELECT id FROM hops)")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requested seeds the common closure lacks."""
    seeds = fx.papers(spark, sf_dir).where("priority = '2-HIGH'").select(F.col("wid").alias("id"))
    return contracts.outside(seeds, hops(spark, sf_dir)).agg(F.count("*").alias("outside"))


@registry("c2_scores_complete", "hops", f"WITH {RANK_VIEWS}, {rank_sql()} SELECT count(*) FILTER (r.r IS NULL) AS unscored, count(*) FILTER (h.id IS NULL) AS strangers, count(r.r) FILTER (r.r > 0) AS positive FROM hops h FULL JOIN r20 r ON h.id = r.id")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every projected node has a score, and nothing else does."""
    nodes, edges = projected(spark, sf_dir)
    scores = graph.article_rank(nodes, edges, {"score": F.col("hop") == 0})
    both = contracts.compared(nodes, scores.where("score IS NOT NULL")).select(F.col("missing").alias("unscored"), F.col("extra").alias("strangers"))
    return both.join(F.broadcast(scores.agg(F.count_if(F.col("score") > 0).alias("positive"))))


@registry("x5_union_closure", "edges papers", """
WITH """ + fx.walk_sql("a", "SELECT wid, 0 FROM papers WHERE priority = '1-URGENT' AND sid % 50 = 0") + ",\n" + fx.walk_sql("b", "SELECT wid, 0 FROM papers WHERE priority = '2-HIGH' AND sid % 50 = 0") + """,
u AS (SELECT id FROM a UNION SELECT id FROM b)
SELECT (SELECT count(*) FROM u) AS members, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, round((SELECT count(*) FROM u) / (SELECT count(*) FROM papers)::DOUBLE, 4) AS ratio""")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a union of seeds is the union of their closures, audited both ways."""
    papers = fx.papers(spark, sf_dir).where("sid % 50 = 0").select(F.col("wid").alias("id"), "priority")
    seeds = {k: papers.where(F.col("priority") == p) for k, p in SEED_SETS.items()} | {"any": papers.where(F.col("priority").isin(*SEED_SETS.values()))}
    found = written(graph.closures(fx.edges(spark, sf_dir), seeds), "closures")
    union = contracts.union_members(*[found.where(k).select("id") for k in SEED_SETS])
    closure = found.where("any").select("id")
    n = F.broadcast(fx.table(spark, sf_dir, "orders").agg(F.count("*").alias("n")))
    audit = contracts.compared(union, closure).join(F.broadcast(union.agg(F.count("*").alias("members"))))
    return audit.join(n).select("members", "missing", "extra", F.round(F.col("members") / F.col("n"), 4).alias("ratio"))
