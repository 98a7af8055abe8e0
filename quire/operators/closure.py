"""What pages take along when they are copied: reachability from many roots at once, up to barriers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans import scratch
from quire.plans.joins import join_small


def _reached(refs: DataFrame, roots: DataFrame, objects: DataFrame, stops: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``closures`` and ``closure_cuts`` share: own, further, inner.

    ``own`` are the roots' references (root, node, there, n_refs, n_open): ``there`` if the node is copied, with the
    number of its references and of those to nodes that are copied. ``further`` (root, node, depth, n_refs, n_open)
    are nodes below, some more than once; ``inner`` (src, dst, there) all references of nodes that may be copied.
    Only rows of nodes that lead on go from round to round.
    """
    roots = scratch.write(roots.select("root").distinct(), "roots")
    marks = objects.select("node", F.lit(1).alias("o"), F.lit(0).alias("s"), F.lit(0).alias("r"))
    marks = marks.union(stops.select("node", F.lit(0), F.lit(1), F.lit(0))).union(roots.select("root", F.lit(0), F.lit(0), F.lit(1)))
    marks = marks.groupBy(F.col("node").alias("k")).agg(((F.max("o") == 1) & (F.max("s") == 0)).alias("there"), (F.max("r") == 1).alias("is_root"))
    marks = scratch.write(marks.where("k is not null and (there or is_root)"), "marks")
    n_there, n_marks = marks.where("there").count(), marks.count()
    there = marks.where("there").select(F.col("k").alias("t"))
    used = join_small(refs.select("src", "dst"), marks, F.col("src") == F.col("k"), "inner", n_marks, 40).select("src", "dst", F.col("there").alias("from_inner"), "is_root").distinct()
    used = scratch.write(used, "refs")
    inner = join_small(used.where("from_inner").select("src", "dst"), there, F.col("dst") == F.col("t"), "left", n_there, 40)
    inner = scratch.write(inner.select("src", "dst", F.col("t").isNotNull().alias("there")), "inner")
    counts = inner.groupBy("src").agg(F.count("*").alias("n_refs"), F.count_if("there").alias("n_open"))
    status = there.join(counts, F.col("t") == F.col("src"), "left").select("t", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.coalesce("n_open", F.lit(0)).alias("n_open"))
    status = scratch.write(status, "status")
    own = join_small(used.where("is_root").select(F.col("src").alias("root"), F.col("dst").alias("node")), status, F.col("node") == F.col("t"), "left", n_there, 56)
    own = scratch.write(own.select("root", "node", F.col("t").isNotNull().alias("there"), "n_refs", "n_open"), "own")
    edges = scratch.write(join_small(inner.where("there").select("src", "dst"), status, F.col("dst") == F.col("t"), "inner", n_there, 56).drop("t"), "edges")
    on, ends = edges.where("n_open > 0"), edges.where("n_open = 0")
    n_on, n_ends = on.count(), ends.count()

    def below(front: DataFrame, edges: DataFrame, n: int) -> DataFrame:
        nxt = join_small(front.select("root", "node", "depth"), edges, F.col("node") == F.col("src"), "inner", n, 80)
        return nxt.where("dst != root").select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), "n_refs", "n_open")

    front = own.where("there and node != root and n_open > 0").select("root", "node", F.lit(1).alias("depth"), "n_refs", "n_open")
    seen = front
    for _ in range(most_rounds if n_on else 0):
        nxt = below(front, on, n_on).distinct()
        front = scratch.write(nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    else:
        if n_on:
            raise RuntimeError(f"the graph is deeper than {most_rounds}")
    return own, seen.union(below(seen, ends, n_ends)), inner


def closures(refs: DataFrame, roots: DataFrame, objects: DataFrame, stops: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(root, node, depth, copy_no): the objects copied with each root (depth 0), numbered from 1 by depth and node.

    ``refs`` are (src, dst), ``roots`` (root), ``objects`` (node) all that exist, ``stops`` (node) what is never copied
    along, other pages and page-tree nodes: a root is copied though it is a stop, but not as another's object. Nodes
    without references that lead on are joined once, at the end. A graph deeper than ``most_rounds`` raises. Numbers
    count one root's objects.
    """
    own, further, _ = _reached(refs, roots, objects, stops, most_rounds)
    every = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    every = every.union(own.where("there and node != root").select("root", "node", F.lit(1))).union(further.select("root", "node", "depth"))
    met = every.repartition("root").groupBy("root", "node").agg(F.min("depth").alias("depth"))
    return met.withColumn("copy_no", F.row_number().over(Window.partitionBy("root").orderBy("depth", "node")))


def closure_cuts(refs: DataFrame, roots: DataFrame, objects: DataFrame, stops: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``cut_references`` of ``closures`` of the same tables, from numbers of references that come with the nodes.

    A copied node's reference to a node that may be copied is kept, for the closure holds that too; another is only
    kept if it leads back to the root. So no pair of root and reference is made but those that lead back.
    """
    own, further, inner = _reached(refs, roots, objects, stops, most_rounds)
    no = F.lit(0)
    held = F.col("there") | F.coalesce(F.col("node") == F.col("root"), F.lit(False))
    rows = own.select("root", "node", F.col("there").cast("int").alias("copied"), "n_refs", "n_open", F.lit(1).alias("mine"), held.cast("int").alias("mine_kept"), no.alias("back"))
    rows = rows.union(further.select("root", "node", F.lit(1), "n_refs", "n_open", no, no, no))
    rows = rows.union(inner.where("not there and dst is not null").select("dst", "src", no, F.lit(None), F.lit(None), no, no, F.lit(1)))
    most = ("copied", "n_refs", "n_open", "mine", "mine_kept", "back")
    met = rows.repartition("root").groupBy("root", "node").agg(*(F.max(c).alias(c) for c in most))
    below = (F.col("copied") == 1) & (F.col("node") != F.col("root"))
    kept = F.col("mine_kept") + F.when(below, F.col("n_open") + F.col("back")).otherwise(0)
    every = F.col("mine") + F.when(below, F.col("n_refs")).otherwise(0)
    sums = met.groupBy("root").agg(F.sum(kept).alias("kept"), F.sum(every).alias("every"))
    # What leads back to a stop that is no root has met no copy and counts nothing.
    return sums.where("every > 0").select("root", "kept", (F.col("every") - F.col("kept")).alias("dropped"))


def cut_references(refs: DataFrame, copied: DataFrame) -> DataFrame:
    """(root, kept, dropped): references of copied objects (root, node) to copied ones, and those that become null."""
    out = copied.select("root", "node").join(refs.select(F.col("src").alias("node"), "dst").distinct(), "node")
    there = copied.select("root", F.col("node").alias("dst"), F.lit(True).alias("there"))
    return out.join(there, ["root", "dst"], "left").groupBy("root").agg(F.count("there").alias("kept"), F.count_if(F.col("there").isNull()).alias("dropped"))
