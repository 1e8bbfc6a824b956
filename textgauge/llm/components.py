"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so that a node with
very many neighbours is never gathered in one place; AQE splits the skewed side of the join.
Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.llm.common import discard, written

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    low = both.groupBy("a").agg(F.min("b").alias("lowest")).select(F.col("a").alias("key"), F.least("a", "lowest").alias("m"))
    joined = both.where("b > a").join(low, F.col("a") == F.col("key"))
    return joined.select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of a node, and itself, on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low.withColumnRenamed("u", "key"), F.col("u") == F.col("key"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Loops and repeated edges are harmless; edges with a null end are no edges; no edges, no rows.
    """
    u, v = F.greatest(src, dst), F.least(src, dst)
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    state = written(known.select(u.alias("u"), v.alias("v")).distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        row = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if row.n == 0 or (row.n, row.h) == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
        mark, before = (row.n, row.h), state
        state = written(_small_star(_large_star(before)), "edges")
        discard(before)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
