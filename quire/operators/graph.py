"""Object graphs: reachability, inheritance, tree walks, copies, last versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans import scratch

#: Numbers of one span, and rows of one part, of ``islands``.
SPAN, PART_ROWS = 4096, 200_000


def reachable(refs: DataFrame, roots: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, depth): nodes that follow from ``roots`` (node); semi-naive, each round only joins the last front."""
    seen = scratch.write(roots.select("node", F.lit(0).alias("depth")).distinct(), "reach")
    front = seen
    for depth in range(1, most_rounds + 1):
        nxt = refs.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        nxt = scratch.write(nxt.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")), "front")
        if nxt.isEmpty():
            return seen
        seen, front = seen.unionByName(nxt), nxt
    raise RuntimeError(f"the graph is deeper than {most_rounds}")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key; a max_by that is combined before the shuffle, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def first_copies(rows: DataFrame, id_col: str, content: list[str]) -> DataFrame:
    """(id, keep_id): each row's first copy with equal content, by a digest of all content columns."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    hashed = rows.select(id_col, digest.alias("d"))
    first = hashed.groupBy("d").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("n"))
    several = first.where("n > 1").select("d", "keep_id")
    return hashed.join(several, "d", "left").select(id_col, F.coalesce("keep_id", id_col).alias("keep_id"))


def islands(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, last): runs of consecutive numbers.

    Rows meet by key and span of SPAN numbers, in as many parts as the rows ask for, so that no task holds more however
    many there are. Only runs that reach an edge of their span are compared across spans: two of them a span at most.
    """
    rows = rows.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    n = rows.count()
    span = F.floor(F.col("_value") / SPAN).alias("_span")
    parts = max(1, -(-n // PART_ROWS))
    each = rows.select("_key", span, "_value").repartition(parts, "_key", "_span").distinct()
    near = Window.partitionBy("_key", "_span").orderBy("_value")
    runs = each.withColumn("_g", F.col("_value") - F.row_number().over(near)).groupBy("_key", "_span", "_g").agg(F.min("_value").alias("first"), F.max("_value").alias("last"))
    runs = scratch.write(runs.select("_key", "first", "last"), "runs")
    edge = F.coalesce((F.pmod("first", F.lit(SPAN)) == 0) | (F.pmod("last", F.lit(SPAN)) == SPAN - 1), F.lit(False))
    across = Window.partitionBy("_key").orderBy("first")
    new = F.coalesce((F.col("first") != F.lag("last").over(across) + 1).cast("int"), F.lit(1))
    joined = runs.where(edge).withColumn("_new", new).withColumn("_g", F.sum("_new").over(across))
    joined = joined.groupBy("_key", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_g")
    return runs.where(~edge).union(joined).withColumnRenamed("_key", key)
