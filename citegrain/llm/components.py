"""Connected components of a table of links, without gathering them anywhere.

Each round, every node points to the smallest node among its neighbours and itself, then to where
that one points; links are replaced by the links between the nodes pointed at, and those inside one
node go. The number of links falls with every round; the rounds' pointers are then composed. Sums
of work are joins and aggregates by node: a node with very many links is pre-aggregated before the
shuffle, and in the joins it is a skewed key of the links' side, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): bigint; root is one node of the component."""
    left = written(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not left.isEmpty():
        both = left.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        near = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to"))
        next_ = near.select(F.col("node").alias("to"), F.col("to").alias("end"))
        near = written(near.join(next_, "to").select("node", F.col("end").alias("to")), "pointers")
        rounds.append(near)
        a, b = near.select(F.col("node").alias("a"), F.col("to").alias("x")), near.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = left.join(a, "a").join(b, "b").where("x != y")
        left = written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].withColumnRenamed("to", "root")
    for near in rounds[1:]:
        out = out.join(near.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
