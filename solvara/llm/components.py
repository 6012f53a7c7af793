"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node that it reaches.

    Every round replaces edges by edges to smaller neighbours: minima are partial aggregates and the join back is
    an ordinary equi-join (which adaptive execution splits when one node holds many edges).  Each round is written
    to the shared folder, and the loop ends when a round leaves the edge set as it was.
    """
    now = materialize(edges.where(F.col("a") != F.col("b"))
                      .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of u moves to u's smallest neighbour (u included)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_min, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(moved.union(small_min.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if state == before or not state[0]:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
