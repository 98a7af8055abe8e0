"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans import scratch
from quire.plans.joins import join_small


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One star step over at most ``most`` edges (a, b) with a > b.

    A hub's edges meet its minimum by broadcast while minima are few, else in a join that may be split.
    """
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = join_small(near, low, "u", "inner", 2 * most)
    moved = joined.where("v > u" if large else "v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without an edge are not listed.

    ``edges`` has two integer columns; direction, loops and repeats do not matter. Each round is
    written to the shared scratch folder. The edge set shrinks to one star per component.
    """
    a, b = edges.columns[:2]
    now = scratch.write(
        edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
        .where("a != b")
        .distinct(),
        "edges",
    )
    sums = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    mark = now.agg(*sums).first()
    for _ in range(most_rounds):
        if not mark[0]:
            break
        now = scratch.write(_star(_star(now, True, mark[0]), False, 2 * mark[0]), "edges")
        if (then := now.agg(*sums).first()) == mark:
            break
        mark = then
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    low = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(low)
