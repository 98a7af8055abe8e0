"""Sums over trees of any depth, by doubling: a tree of depth d takes about log2(d) rounds of one row a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import scratch


def subtree_sums(nodes: DataFrame, weight: Column, passes: Column | None = None, deepest: int = 1 << 20) -> DataFrame:
    """(node, total): the weights of all nodes below each node of ``nodes`` (node, parent), itself not counted.

    What lies below a node counts further up only if the node ``passes`` (null: yes). In round k a node knows its sum
    down to 2 ** k levels and its ancestor 2 ** k levels up, so both double with one join each. A parent that is no
    node counts like none; a circle of parents, or a tree deeper than ``deepest``, raises.
    """
    passes = F.lit(True) if passes is None else F.coalesce(passes, F.lit(True))
    rows = scratch.write(nodes.select("node", "parent", weight.cast("long").alias("w"), passes.alias("passes")), "nodes")
    below = rows.groupBy(F.col("parent").alias("p")).agg(F.sum("w").alias("s"))
    known = rows.select(F.col("node").alias("up"))
    now = rows.join(below, F.col("node") == F.col("p"), "left").join(known, F.col("parent") == F.col("up"), "left")
    now = scratch.write(now.select("node", F.coalesce("s", F.lit(0)).alias("total"), F.when(F.col("passes"), F.col("up")).alias("jump")), "sums")
    depth = 1
    while not now.where("jump is not null").isEmpty():
        if depth > deepest:
            raise RuntimeError(f"parents form a circle, or a tree is deeper than {deepest}")
        added = now.groupBy(F.col("jump").alias("p")).agg(F.sum("total").alias("s"))
        over = now.select(F.col("node").alias("n"), F.col("jump").alias("far"))
        now = now.join(added, F.col("node") == F.col("p"), "left").join(over, F.col("jump") == F.col("n"), "left")
        now = scratch.write(now.select("node", (F.col("total") + F.coalesce("s", F.lit(0))).alias("total"), F.col("far").alias("jump")), "sums")
        depth *= 2
    return now.select("node", "total")


def choose_catalogue(objects: DataFrame, key: str) -> DataFrame:
    """(key, root, made): the catalogue of each file of objects (key, id, kind, has_pages, has_kids, parent, count).

    The last catalogue that has pages; else a new one (``made``) over the page node without a parent that counts most
    pages, the last of equals; else a new one over nothing (null). One combined aggregation, no window.
    """
    usable = (F.col("kind") == "Catalog") & F.col("has_pages")
    top = (F.col("kind") == "Pages") & F.col("has_kids") & F.col("parent").isNull()
    found = objects.groupBy(key).agg(
        F.max(F.when(usable, F.col("id"))).alias("catalogue"),
        F.max(F.when(top, F.struct(F.coalesce("count", F.lit(0)).alias("n"), "id"))).alias("top"),
    )
    return found.select(key, F.coalesce("catalogue", "top.id").alias("root"), F.col("catalogue").isNull().alias("made"))
