"""Connected components of an edge table by alternating large-star and small-star steps, all of them joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One step over (a, b), and a table it reads: each node's neighbours (larger ones in a large step, smaller ones in a small step) move to the least of all of them.

    The least neighbours, combined before their shuffle, are written first. The join then has two plain shuffles as inputs, so that
    Spark can split the many edges of one node over tasks.
    """
    both = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least-neighbours")
    moved = both.hint("merge").join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), least
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", "low")).where("a <> b").distinct(), least


def settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b), a > b, are stars about their least nodes: no a has two edges or is the b of another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up = 1 and down > 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable. Self-loops and repeats are allowed, nulls are not.

    Each round is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of the graph's size and end when stars are left.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "edges")
    for _ in range(most_rounds):
        before, (pulled, one) = now, star(now, large=True)
        pulled = written(pulled, "edges")
        moved, two = star(pulled, large=False)
        now = written(moved, "edges")
        dropped(before, one, pulled, two)
        if settled(now):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
