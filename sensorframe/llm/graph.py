"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.store import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node over undirected ``edges`` (a, b).

    Large-star and small-star rounds: each round hangs the larger neighbours, then the smaller ones, on the
    smallest neighbour, until nothing moves; the number of rounds grows with the logarithm of a component's
    size. A node with very many neighbours meets them in an aggregation with map-side combine and in a join,
    never in one task. Loops, repeated edges and nulls are ignored; nodes without an edge do not appear.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        moves = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        small = large.join(least, "a").select(F.explode(moves).alias("e"))
        before, now = now, materialise(small.select("e.a", "e.b").where("a <> b").distinct())
        release(before)
        # A fixed point is a set of stars: every node hangs on one root and no root hangs on another.
        roles = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("r"))
        seen = roles.groupBy("r.n").agg(F.sum("r.up").alias("parents"), F.min("r.up").alias("least"))
        if seen.where("parents > 1 or parents = 1 and least = 0").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
