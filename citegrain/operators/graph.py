"""Reachability and rank on a citation graph held as edges (src, dst), in DataFrames.

Loops run on the driver, each step as joins and aggregates. The edges are shuffled once, by the
column that the steps join on, and kept; a step moves only its frontier or its scores. Every few steps
what has been found is written to the shared folder, which keeps plans short and survives lost
executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.storage import new_path, written

#: Rows of a frontier up to which it is sent to all executors instead of being joined by shuffle.
SMALL_FRONTIER = 200_000
#: Steps of a walk that one job takes.
STRIDE = 4


def clean_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Distinct edges both of whose ends are nodes."""
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    out = edges.join(ids.withColumnRenamed("__id", "src"), "src", "left_semi").join(ids.withColumnRenamed("__id", "dst"), "dst", "left_semi")
    return out.select("src", "dst").distinct()


def cited_edges(works: DataFrame, refs: str = "refs") -> DataFrame:
    """Edges from an array of references."""
    return works.select(F.col("id").alias("src"), F.explode(refs).alias("dst"))


def _kept(df: DataFrame, key: str, order: bool = False) -> DataFrame:
    """df by key, in a fixed number of partitions, kept; call unpersist() afterwards."""
    out = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return (out.sortWithinPartitions(key) if order else out).persist(StorageLevel.MEMORY_AND_DISK)


def hop_step(edges: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """The ids that edges lead to from the frontier (id) and that weren't visited (id)."""
    return edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")


def bfs_hops(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(id, hop): the fewest edges from a seed, which has hop 0, along src -> dst. known: hops of an
    earlier run, which stay; the walk goes on from its last hop.

    A job goes STRIDE steps from the frontier. What was found before the job is left out of each step;
    a node found in several of them has the least, which is its distance, as a shortest path from the
    frontier holds nothing found before."""
    by_src, spark = _kept(edges.select("src", "dst"), "src", order=True), edges.sparkSession
    path = new_path(spark, "hops")
    try:
        start = seeds.select(F.col(seeds.columns[0]).cast("bigint").alias("id")).distinct().withColumn("hop", F.lit(0))
        if known is not None:
            start = known.select("id", "hop").unionByName(start.join(known, "id", "left_anti"))
        # one table grows by appends, and hops are counted in a column: every job has the same plan, and
        # runs code that is compiled already
        start.write.parquet(path)
        found = spark.read.schema("id bigint, hop int").parquet(path)
        hop, n = _last(found)
        while n and (max_hops is None or hop < max_hops):
            # kept by id like the ids that a step finds, so that leaving out what is known shuffles nothing
            visited, step, steps = _kept(found.select("id"), "id"), found.where(F.col("hop") == hop), []
            stride = STRIDE if max_hops is None else min(STRIDE, max_hops - hop)
            for k in range(stride):
                ids = step.withColumnRenamed("id", "src")
                ids = F.broadcast(ids) if not k and n <= SMALL_FRONTIER else ids
                step = by_src.join(ids, "src").select(F.col("dst").alias("id"), (F.col("hop") + 1).alias("hop")).groupBy("id").agg(F.min("hop").alias("hop")).join(visited, "id", "left_anti")
                steps.append(step)
            reduce(DataFrame.unionByName, steps).groupBy("id").agg(F.min("hop").alias("hop")).write.mode("append").parquet(path)
            visited.unpersist()
            found = spark.read.schema("id bigint, hop int").parquet(path)
            last, n = _last(found)
            n = n if last == hop + stride else 0
            hop += stride
        return found
    finally:
        by_src.unpersist()


def _last(hops: DataFrame) -> tuple[int, int]:
    """The highest hop, and how many nodes have it."""
    top = hops.groupBy("hop").agg(F.count("*").alias("n")).agg(F.max(F.struct("hop", "n")).alias("top")).first()["top"]
    return (top["hop"], top["n"]) if top else (0, 0)


def closures(edges: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    """(id, a boolean for each set of seeds): whether edges lead from the set to the node, a seed included. All
    sets, at most 63, share one walk: a row of the frontier holds the bits of the sets that are new to its node.

    A job goes STRIDE steps. Bits that were found before the job are left out of each step, and of the last
    step's rows go on those that no earlier step of the job has found."""
    if not 0 < len(seeds) < 64:
        raise ValueError("from 1 to 63 sets of seeds are needed")
    by_src, spark = _kept(edges.select("src", "dst"), "src", order=True), edges.sparkSession
    partitions, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, "closures")
    try:
        start = [s.select(F.col(s.columns[0]).cast("bigint").alias("id"), F.lit(1 << k).cast("bigint").alias("sets")) for k, s in enumerate(seeds.values())]
        start = reduce(DataFrame.unionByName, start).groupBy("id").agg(F.bit_or("sets").alias("sets"))
        start.select("id", "sets", F.col("sets").alias("last"), F.lit(0).alias("job")).write.parquet(path)
        job = 0
        while True:
            found = spark.read.schema("id bigint, sets bigint, last bigint, job int").parquet(path)
            frontier = found.where((F.col("job") == job) & (F.col("last") != 0)).select(F.col("id").alias("src"), F.col("last").alias("sets"))
            n = frontier.count()
            if not n:
                had = found.groupBy("id").agg(F.bit_or("sets").alias("sets"))
                return had.select("id", *[(F.col("sets").bitwiseAND(F.lit(1 << k)) != 0).alias(name) for k, name in enumerate(seeds)])
            visited = found.repartition(partitions, "id").groupBy("id").agg(F.bit_or("sets").alias("had")).persist(StorageLevel.MEMORY_AND_DISK)
            steps, job = [], job + 1
            for k in range(STRIDE):
                step = frontier if k or n > SMALL_FRONTIER else F.broadcast(frontier)
                step = by_src.join(step, "src").groupBy(F.col("dst").alias("id")).agg(F.bit_or("sets").alias("sets")).join(visited, "id", "left")
                step = step.select("id", F.col("sets").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0)))).alias("sets")).where("sets != 0")
                steps.append(step.select("id", "sets", F.lit(k).alias("k")))
                frontier = step.withColumnRenamed("id", "src")
            early = F.coalesce(F.bit_or(F.when(F.col("k") < STRIDE - 1, F.col("sets"))), F.lit(0))
            late = F.coalesce(F.bit_or(F.when(F.col("k") == STRIDE - 1, F.col("sets"))), F.lit(0))
            rows = reduce(DataFrame.unionByName, steps).groupBy("id").agg(F.bit_or("sets").alias("sets"), late.bitwiseAND(F.bitwise_not(early)).alias("last"))
            rows.withColumn("job", F.lit(job)).write.mode("append").parquet(path)
            visited.unpersist()
    finally:
        by_src.unpersist()


def anchor_hops(edges: DataFrame, seeds: DataFrame, anchor: int = -1) -> DataFrame:
    """The same by shortest paths of unit weight from one anchor that is linked to all seeds: hops are
    its distances less one."""
    linked = seeds.select(F.lit(anchor).cast("bigint").alias("src"), F.col(seeds.columns[0]).alias("dst"))
    spark = edges.sparkSession
    found = bfs_hops(edges.select("src", "dst").unionByName(linked), spark.range(1).select(F.lit(anchor).cast("bigint").alias("id")))
    return found.where("hop > 0").select("id", (F.col("hop") - 1).cast("int").alias("hop"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """(id, hop) within some hops, along, against or along either way of the edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = {"out": edges.select("src", "dst"), "in": back, "both": edges.select("src", "dst").unionByName(back)}
    return bfs_hops(ways[direction], seeds, hops)


def project(nodes: DataFrame, edges: DataFrame, keep: Column, year: str | None = None, low: int | None = None, high: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes that keep holds for (within years, where a bound is given) and the edges among them."""
    kept = nodes.where(keep)
    if low is not None:
        kept = kept.where(F.col(year) >= low)
    if high is not None:
        kept = kept.where(F.col(year) <= high)
    return kept, clean_edges(edges, kept)


def contract(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct edges between the groups (id, group) that the ends are in."""
    a, b = groups.select(F.col("id").alias("src"), F.col("group").alias("from")), groups.select(F.col("id").alias("dst"), F.col("group").alias("to"))
    return edges.join(a, "src").join(b, "dst").select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()


def source_nodes(nodes: DataFrame, *flags: str) -> DataFrame:
    """The nodes for which one of the properties is true; an absent one is not."""
    if not flags:
        raise ValueError("a property is needed")
    return nodes.where(reduce(Column.__or__, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


@dataclass(frozen=True)
class Ranked:
    """Scores (id, one for each set of seeds), the steps that were made, and whether they have settled."""

    scores: DataFrame
    steps: int
    settled: bool


def ranked(nodes: DataFrame, edges: DataFrame, seeds: dict[str, Column], damping: float | dict[str, float] = 0.85, iterations: int = 20, tolerance: float | None = None, every: int = 10) -> Ranked:
    """Personalised ArticleRank by synchronous steps from r = b: r' = b + d * sum over citing w of
    r(w) / (outdegree(w) + mean outdegree), with b = 1 - d for a seed and 0 otherwise. All sets, which may
    have dampings of their own, share one pass over the edges a step. seeds: for each score's name, a
    condition on nodes.

    A job makes `every` steps. With a tolerance it makes one, and the run ends after the first step in which
    no score of any set changes by more."""
    names = list(seeds)
    dampings = damping if isinstance(damping, dict) else dict.fromkeys(names, damping)
    if any(not 0 < dampings[k] < 1 for k in names):
        raise ValueError("the damping must lie between 0 and 1")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = nodes.select("id", *[F.when(F.coalesce(c, F.lit(False)), 1 - dampings[k]).otherwise(0.0).alias(k) for k, c in seeds.items()])
    base = written(base, "rank-base").repartition(partitions, "id").persist(StorageLevel.MEMORY_AND_DISK)
    weighted = None
    try:
        total = base.count()
        if not total:
            raise ValueError("the projected graph has no node")
        edges = written(edges.select("src", "dst"), "rank-edges")
        mean = edges.count() / total
        degrees = edges.groupBy("src").agg(F.count("*").alias("degree"))
        weighted = _kept(edges.join(degrees, "src").select("src", "dst", (1 / (F.col("degree") + mean)).alias("w")), "src", order=True)

        def step(rank: DataFrame) -> DataFrame:
            flow = weighted.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col(k) * F.col("w")).alias(f"in_{k}") for k in names])
            return base.join(flow, "id", "left").select("id", *[(F.col(k) + dampings[k] * F.coalesce(f"in_{k}", F.lit(0.0))).alias(k) for k in names])

        rank = base
        for made in range(1, iterations + 1):
            before, rank = rank, step(rank)
            if tolerance is not None:
                rank = written(rank, "rank")
                both = rank.join(before.select("id", *[F.col(k).alias(f"was_{k}") for k in names]), "id")
                change = both.agg(F.max(F.greatest(*[F.abs(F.col(k) - F.col(f"was_{k}")) for k in names], F.lit(0.0)))).first()[0]
                if change <= tolerance:
                    return Ranked(rank, made, True)
            elif made % every == 0 or made == iterations:
                rank = written(rank, "rank")
        return Ranked(rank if iterations else written(rank, "rank"), iterations, False)
    finally:
        base.unpersist()
        if weighted is not None:
            weighted.unpersist()


def article_rank(nodes: DataFrame, edges: DataFrame, seeds: dict[str, Column], damping: float | dict[str, float] = 0.85, iterations: int = 20, every: int = 10) -> DataFrame:
    """The scores of `ranked` after a fixed number of steps."""
    return ranked(nodes, edges, seeds, damping, iterations, None, every).scores


def scaled(df: DataFrame, column: str, scaler: str) -> DataFrame:
    """The column rescaled over all rows: minmax, max, mean, log, center or stdscore."""
    x = F.col(column)
    stats = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"), F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__sd"), F.max(F.abs(column)).alias("__top"))
    low, high, mean, sd, top = (F.col(c) for c in ("__low", "__high", "__mean", "__sd", "__top"))
    ways = {
        "minmax": F.when(high > low, (x - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0),
        "max": F.when(top > 0, x / F.nullif(top, F.lit(0.0))).otherwise(0.0),
        "mean": F.when(high > low, (x - mean) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0),
        "log": F.log(x + 1),
        "center": x - mean,
        "stdscore": F.when(sd > 0, (x - mean) / F.nullif(sd, F.lit(0.0))).otherwise(0.0),
    }
    return df.join(F.broadcast(stats)).withColumn(column, ways[scaler]).select(df.columns)
