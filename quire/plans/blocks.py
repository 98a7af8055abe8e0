"""Range blocks: a global order over a key without one task that sees all rows.

Splitters are approximate percentiles of the key; a row's block is the number of splitters at or
below its key, found by binary search. Work inside a block runs in parallel; what crosses blocks
is one row per block.

Percentiles give at most MOST_CUTS blocks; ``blocks_of`` cuts each of them again in equal steps of the key, so
that the number of blocks grows with the rows while the plan holds the same few splitters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_CUTS = 1000


def splitters(df: DataFrame, key: str, rows_per_block: int = 1000, max_blocks: int = 2000) -> list:
    """At most ``max_blocks - 1`` distinct splitters of a numeric key, from all rows."""
    n = df.where(F.col(key).isNotNull()).count()
    blocks = max(1, min(max_blocks, n // rows_per_block))
    if blocks == 1:
        return []
    at = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(key, F.lit(at), F.lit(10_000)).alias("s")).first()["s"]
    return sorted(set(found))


def block_of(key: str | Column, cuts: list) -> Column:
    """Number of ``cuts`` that are at or below ``key`` (null: 0); a binary search in SQL."""
    key = F.col(key) if isinstance(key, str) else key
    if not cuts:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    cut = F.lit(cuts)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(cuts)) & (F.get(cut, at + step - 1) <= F.coalesce(key, F.lit(cuts[0] - 1))), at + step
        ).otherwise(at),
    )


def blocks_of(df: DataFrame, key: str, rows_per_block: int = 1000) -> Callable[[str | Column], Column]:
    """A function from a key to its block, in the keys' order, with about ``rows_per_block`` rows in each.

    Keys between two splitters are cut in equal steps, so blocks are even where keys are spread evenly there
    and hold more rows where they are not; the order is exact in any case. Null keys are in block 0.
    """
    cuts = splitters(df, key, rows_per_block, MOST_CUTS)
    if not cuts:
        return lambda key: F.lit(0).cast("long")
    about = df.agg(F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    steps = max(1, round(about["n"] / (len(cuts) + 1) / rows_per_block))
    edges = [about["low"], *cuts, about["high"] + 1]
    starts = F.lit([float(e) for e in edges[:-1]])
    widths = F.lit([float(max(1, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def block(key: str | Column) -> Column:
        key = F.col(key) if isinstance(key, str) else key
        at = block_of(key, cuts)
        if steps == 1:
            return at.cast("long")
        # Numbers as doubles: rounding is monotone, so the order of keys stays.
        inside = F.floor((key.cast("double") - F.get(starts, at)) / F.get(widths, at) * steps)
        return at.cast("long") * steps + F.greatest(F.lit(0), F.least(F.coalesce(inside, F.lit(0)), F.lit(steps - 1)))

    return block


def number_in_order(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """``df`` with the row's number (from 1) in its group by a numeric column; ties in any order.

    A group may hold all rows: windows run over its blocks, and over one row for each block.
    """
    rows = df.withColumn("_blk", blocks_of(df, order)(order))
    keys = [*group, "_blk"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"{k}_") for k in keys), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    joined = own.join(starts, same).withColumn(name, F.col("_start") + F.col("_k"))
    return joined.drop("_blk", "_k", "_start", *(f"{k}_" for k in keys))


def free_number(k: Column, taken: Column) -> Column:
    """The k-th number that is not in the sorted array ``taken`` (null: none)."""
    return F.aggregate(F.coalesce(taken, F.array().cast("array<long>")), k.cast("long"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))


def last_at_most(edges: Column, key: Column) -> Column:
    """Number of elements of the sorted array ``edges`` that are at or below ``key``; a binary search in SQL."""
    steps = F.lit([1 << i for i in reversed(range(31))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((step <= F.size(edges) - at) & (F.get(edges, at + step - 1) <= key), at + step).otherwise(at),
    )
