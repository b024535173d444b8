import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.operators import contracts, graph, sampling, seeds, solvers, stats, suites, venues, windows
from citegrain.plans import graph_queries

#: A cycle, a self-loop, a repeated edge, an edge to a missing node, and a node apart.
EDGES = [(1, 2), (2, 3), (3, 1), (3, 3), (2, 3), (3, 4), (4, 99), (5, 6)]


@pytest.fixture(scope="module")
def edges(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id bigint")
    return graph.clean_edges(spark.createDataFrame(EDGES, "src bigint, dst bigint"), nodes)


def seeds_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def as_dict(df):
    return {r["id"]: r["hop"] for r in df.collect()}


def test_clean_edges(edges):
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3), (3, 1), (3, 3), (3, 4), (5, 6)]


def test_hops(spark, edges):
    assert as_dict(graph.bfs_hops(edges, seeds_of(spark, 1))) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert as_dict(graph.bfs_hops(edges, seeds_of(spark, 1, 3, 3))) == {1: 0, 3: 0, 2: 1, 4: 1}
    assert as_dict(graph.bfs_hops(edges, seeds_of(spark, 1), 1)) == {1: 0, 2: 1}
    assert as_dict(graph.bfs_hops(edges, seeds_of(spark))) == {}
    assert as_dict(graph.anchor_hops(edges, seeds_of(spark, 1, 5))) == {1: 0, 5: 0, 2: 1, 6: 1, 3: 2, 4: 3}
    assert as_dict(graph.expand(edges, seeds_of(spark, 4), 1, "in")) == {4: 0, 3: 1}
    resumed = graph.bfs_hops(edges, seeds_of(spark, 1), known=graph.bfs_hops(edges, seeds_of(spark, 1), 2))
    assert as_dict(resumed) == {1: 0, 2: 1, 3: 2, 4: 3}


def test_closures_of_several_sets_share_a_walk(spark, edges, monkeypatch, sf_dir):
    """What each set reaches, over a path longer than a job, a cycle and a loop; x5 walks over the edges once."""
    path = spark.range(11).selectExpr("id + 10 AS src", "id + 11 AS dst").unionByName(edges)
    sets = {"a": seeds_of(spark, 1, 14), "b": seeds_of(spark, 3, 3, 5, 10), "none": seeds_of(spark)}
    got = graph.closures(path, sets).collect()
    want = {k: set(as_dict(graph.bfs_hops(path, s))) for k, s in sets.items()}
    assert {k: {r["id"] for r in got if r[k]} for k in sets} == want and len(got) == len({r["id"] for r in got})
    walks, kept = [], graph._kept
    monkeypatch.setattr(graph, "_kept", lambda df, key, *a, **b: walks.append(key) or kept(df, key, *a, **b))
    graph_queries.x5(spark, sf_dir).collect()
    assert walks.count("src") == 1


def test_long_path_goes_over_several_jobs(spark):
    path = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert as_dict(graph.bfs_hops(path, seeds_of(spark, 0))) == {i: i for i in range(31)}


def test_rank_is_the_matrix_series_and_linear_in_seeds(spark, edges):
    nodes = seeds_of(spark, *range(1, 8))
    got = graph.article_rank(nodes, edges, {"a": F.col("id") == 1, "b": F.col("id") == 5, "both": F.col("id").isin(1, 5)}, 0.85, 6, 4).collect()
    e = [(1, 2), (2, 3), (3, 1), (3, 3), (3, 4), (5, 6)]
    degree, mean = {1: 1, 2: 1, 3: 3, 5: 1}, len(e) / 7
    a = np.zeros((8, 8))
    for s, d in e:
        a[d, s] = 0.85 / (degree[s] + mean)
    b = np.zeros(8)
    b[1] = 0.15
    r = b.copy()
    for _ in range(6):
        r = b + a @ r
    for row in got:
        assert row["a"] == pytest.approx(r[row["id"]])
        assert row["both"] == pytest.approx(row["a"] + row["b"])
    with pytest.raises(ValueError):
        graph.article_rank(nodes, edges, {"a": F.lit(True)}, 1.0)
    with pytest.raises(ValueError):
        graph.article_rank(nodes.limit(0), edges, {"a": F.lit(True)})


def test_rank_stops_by_tolerance(spark, edges):
    nodes = seeds_of(spark, *range(1, 8))
    first = {"a": F.col("id") == 1}
    run = graph.ranked(nodes, edges, first, 0.5, 50, 1e-3)
    steps = [{r["id"]: r["a"] for r in graph.article_rank(nodes, edges, first, 0.5, k).collect()} for k in range(run.steps + 1)]
    changes = [max(abs(b[i] - a[i]) for i in a) for a, b in zip(steps, steps[1:], strict=False)]
    assert run.settled and changes[-1] <= 1e-3 and all(c > 1e-3 for c in changes[:-1])
    assert {r["id"]: r["a"] for r in run.scores.collect()} == pytest.approx(steps[-1])
    short = graph.ranked(nodes, edges, first, 0.5, 1, 1e-9)
    assert (short.steps, short.settled) == (1, False)


def test_dampings_of_one_run(spark, edges):
    nodes = seeds_of(spark, *range(1, 8))
    both = graph.article_rank(nodes, edges, {"x": F.col("id") == 1, "y": F.col("id") == 1}, {"x": 0.5, "y": 0.9}, 5)
    for k, d in (("x", 0.5), ("y", 0.9)):
        alone = graph.article_rank(nodes, edges, {k: F.col("id") == 1}, d, 5)
        assert sorted(map(tuple, both.select("id", k).collect())) == [pytest.approx(r) for r in sorted(map(tuple, alone.collect()))]


def test_suites_rank_on_the_common_closure(spark, edges):
    nodes = seeds_of(spark, *range(1, 8))
    got = {r["id"]: r for r in suites.seed_suite(nodes, edges, {"a": F.col("id") == 1, "b": F.col("id") == 5}, iterations=4).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]  # 7 is in no closure
    assert got[6]["a"] == 0 and got[6]["b"] > 0 and got[5]["b"] == pytest.approx(0.15)
    drawn = spark.createDataFrame([(7, 2), (7, 5), (8, 3)], "draw int, id bigint")
    arms = suites.placebo_suite(nodes, edges, F.col("id") == 1, drawn, [7, 8])
    assert arms.columns == ["id", "true", "placebo_1", "placebo_2"]


def test_places_of_a_total_order(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    got = {r["v"]: r["place"] for r in windows.placed(rows.repartition(7), F.col("v").desc()).collect()}
    assert got == {v: 1000 - v for v in range(1000)}
    assert windows.placed(rows.limit(0), F.col("v")).count() == 0
    assert [r["id"] for r in windows.page_after(rows.select("id"), "id", 995, 10).collect()] == [996, 997, 998, 999]


def test_patches_are_left_out_when_done(spark):
    rows, ids = seeds_of(spark, *range(10)), seeds_of(spark, 2, 3)
    once, first = contracts.patched(rows, ids, "flag")
    again, second = contracts.patched(once, ids, "flag")
    assert (first, second, again is once) == (True, False, True)
    assert contracts.patched(once, ids, "flag", force=True)[1] and contracts.patched(once, seeds_of(spark, 2), "flag")[1]
    assert contracts.patched(once.fillna(False, ["flag"]), ids, "flag")[1]  # false where it should be absent
    with pytest.raises(contracts.ContractError):
        contracts.patched(rows, seeds_of(spark, 77), "flag")
    summary = spark.sql("SELECT 1 AS total, 1 AS committed, 0 AS failed, array() AS errors")
    contracts.all_done(summary)
    with pytest.raises(contracts.ContractError):
        contracts.all_done(summary.withColumn("committed", F.lit(0)))


def test_h_index(spark):
    papers = spark.createDataFrame([("a", c) for c in (9, 5, 3, 3, 1)] + [("b", 0), (None, 7)], "source_id string, cited_by_count int")
    assert {r["source_id"]: r["h"] for r in venues.h_index(papers).collect()} == {"a": 3, "b": 0}


def test_bootstrap_weights_and_matrices(spark):
    keys = np.arange(400)
    w = stats.replicate_weights(keys, 3, 50)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    rows = spark.range(0, 400, 1, 5).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    got = {r["replicate"]: r for r in stats.replicated_grams(rows, ["x", "y"], "id", 3, 50).collect()}
    z = np.column_stack([np.ones(400), keys % 17, keys % 5])
    for k in (1, 50):
        g = z.T @ (z * w[:, k - 1 : k])
        assert [got[k][f"g_{i}_{j}"] for i in range(3) for j in range(i, 3)] == pytest.approx([g[i, j] for i in range(3) for j in range(i, 3)])


def test_anova_and_hurdle():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, 0.3, 0.0] + rng.normal(size=300)
    z = np.column_stack([np.ones(300), x, x[:, 0], y])  # the fourth predictor repeats the first
    rows = solvers.anova({"a": [1], "b": [2, 3], "c": [4]}, z.T @ z, 5)
    rss = lambda k: float(np.linalg.lstsq(z[:, :k], y, rcond=None)[1][0])
    want = [(1, rss(1) - rss(2)), (2, rss(2) - rss(4)), (0, 0.0)]
    for (_, df, ss, f, p), (d, s) in zip(rows, want, strict=True):
        assert df == d and ss == pytest.approx(s, abs=1e-6)
        if d:
            assert f == pytest.approx(s / d / (rss(4) / 296))
    # fixed values of the F distribution
    assert solvers.f_tail(4.0, 1, 10) == pytest.approx(0.07339, abs=1e-5)
    assert solvers.f_tail(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-5)
    assert solvers.f_tail(1.0, 7, 7) == pytest.approx(0.5)
    some = rng.random(300) < 1 / (1 + np.exp(-x[:, 0]))
    amount = np.where(some, np.exp(0.5 + x[:, 1] + 0.1 * rng.normal(size=300)), 0)
    beta, gamma, d2, r2 = solvers.hurdle_fit(z[:, :3], amount)
    assert beta[1] == pytest.approx(1, abs=0.4) and gamma[:] == pytest.approx([0.5, 0, 1], abs=0.1) and 0 < d2 < 1 and r2 > 0.9


def test_contracts(spark):
    a, b = seeds_of(spark, 1, 2, 3), seeds_of(spark, 2, 3, 4)
    assert contracts.compared(a, b).first().asDict() == {"missing": 1, "extra": 1}
    with pytest.raises(contracts.ContractError):
        contracts.exactly(a, b)
    contracts.exactly(a, seeds_of(spark, 3, 2, 1))
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(a, "id", "x")


def test_young_firms(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('before', date'2000-12-31', 0, 2001), ('same', date'2000-12-31', 1, 2001), ('three', date'2004-01-01', 0, 2001), ('four', date'2005-01-01', 0, 2001), ('none', NULL, 0, 2001) AS v(id, d, days, fy)""")
    got = rows.select("id", seeds.young(F.array(F.struct(F.col("days"), F.col("fy").alias("founded"))), F.col("d")).alias("young")).collect()
    assert dict(map(tuple, got)) == {"before": False, "same": True, "three": True, "four": False, "none": False}


def test_draws_do_not_depend_on_order(spark):
    papers = spark.range(600).select(F.col("id").alias("wid"), (F.col("id") % 2).cast("int").alias("field"), F.lit(2000).alias("year"), (F.col("id") % 5).alias("cites"), (F.col("id") % 20 == 0).alias("is_seed"))
    hist = papers.groupBy("field", "year", "cites").agg(F.count("*").alias("n"), F.count_if("is_seed").alias("k"))
    ranked, cells = sampling.frame(hist, "k")
    one = sampling.draws(papers, ranked, cells, [7]).collect()
    two = sampling.draws(papers.orderBy(F.rand(3)).repartition(7), ranked, cells, [7]).collect()
    assert sorted(one) == sorted(two)
    quotas = {(r["field"], r["year"], r["bin"]): r["quota"] for r in cells.collect()}
    for key, n in quotas.items():
        assert sum((r["field"], r["year"], r["bin"]) == key for r in one) == n
    assert not {r["wid"] for r in one} & set(range(0, 600, 20))


def test_average_ranks_of_ties(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    assert sorted(r[0] for r in rows.select(windows.average_rank(F.col("v"))).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_solvers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, 2.0, 0.0] + rng.normal(size=500)
    z = np.column_stack([np.ones(500), x, y])
    g = z.T @ z
    full = solvers.r_squared(g, [1, 2, 3], 4)
    fit = np.linalg.lstsq(z[:, :4], y, rcond=None)[0]
    assert full == pytest.approx(1 - ((y - z[:, :4] @ fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    blocks = {"a": [1], "b": [2], "c": [3]}
    shares = solvers.shapley(list(blocks), lambda s: solvers.r_squared(g, [i for b in s for i in blocks[b]], 4))
    assert sum(shares.values()) == pytest.approx(full)
    assert shares["b"] > shares["a"] > shares["c"]
    n = np.full(200, 50.0)
    p = 1 / (1 + np.exp(-(0.5 + x[:200, 0])))
    beta, deviance = solvers.binomial_fit(np.column_stack([np.ones(200), x[:200, :1]]), rng.binomial(50, p).astype(float), n)
    assert beta == pytest.approx([0.5, 1.0], abs=0.15)
    assert 0 < deviance < 400
    q = solvers.quantile_fit(np.ones((101, 1)), np.arange(101.0), 0.75)[0][0]
    assert q == pytest.approx(75, abs=0.6)
