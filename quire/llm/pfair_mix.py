"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source is cut into blocks of ``block_docs`` documents. With whole shares a_s of a cycle of D
slots, block j of a source (from 0) has release time floor(j * D / a_s) and deadline
ceil((j + 1) * D / a_s). Earliest deadline first gives each slot to the released block with the
earliest deadline. The shares add up to D, so every slot is used, every deadline is met and, while
all sources have blocks, no source is ever a whole block away from its weight. All lags are zero at
a cycle's end: the schedule repeats, and a block's slot is its cycle times D plus its slot in one
cycle. Only that one cycle (D rows) is worked out on the driver.

Where the weights are in a ratio of whole numbers that add up to at most SLOTS, these are the shares: the
bound then holds against the weights themselves in a run of any length. Other weights are rounded to parts of
SLOTS, at least one part each. ``held`` tells the weights that a run holds; against those the bound is exact.

A source that is used up leaves its slots empty; the others keep their order and proportions. No
document is dropped or repeated.

Whole rows move once. Narrow rows (source, id) are numbered first, in range blocks; percentiles of
their slots cut the mixed order into partitions, and one row per source and partition says at which id the
source enters it. By these edges every whole row finds its partition before it moves, and its exact slot
by its rank there.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans import scratch
from quire.plans.blocks import blocks_of, last_at_most, splitters
from quire.plans.joins import is_small, join_small

NEW = ("block_no", "release", "deadline", "slot", "in_block")
SLOTS = 1 << 18
#: Slots of a source that one row of the schedule's table holds.
PER_ROW = 256


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Whole slots of a cycle by largest remainder, at least one for each source."""
    total = sum(weights.values())
    exact = {s: max(w / total * slots, 1e-12) for s, w in weights.items()}
    got = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (got[s] - exact[s], s))
    while (gap := slots - sum(got.values())) > 0:
        for s in order[:gap]:
            got[s] += 1
    while sum(got.values()) > slots:  # sources raised to one slot
        most = max(got, key=lambda s: (got[s], s))
        got[most] -= min(got[most] - 1, sum(got.values()) - slots)
    return got


def held(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """The whole-number weights that a run holds its sources to; their sum is the length of a cycle.

    Weights are read as the decimals that they print as. If their ratio has whole terms with a sum of at most
    ``slots`` (or four for each source, if that is more), it is kept as it is, else rounded to that sum.
    """
    if not weights:
        return {}
    slots = max(slots, 4 * len(weights))
    exact = {s: Fraction(repr(w)) for s, w in weights.items()}
    below = lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * below) for s, x in exact.items()}
    common = gcd(*whole.values())
    if sum(whole.values()) <= slots * common:
        return {s: n // common for s, n in whole.items()}
    return shares(weights, slots)


def cycle(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, j, release, deadline, slot) of one cycle by earliest deadline first."""
    slots = sum(share.values())
    waiting = [(0, -(-slots // a), s, 0) for s, a in share.items()]  # release, deadline, source, j
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for now in range(slots):
        while waiting and waiting[0][0] <= now:
            r, d, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (d, s, j, r))
        d, s, j, r = heapq.heappop(ready)
        out.append((s, j, r, d, now))
        a = share[s]
        if j + 1 < a:
            heapq.heappush(waiting, ((j + 1) * slots // a, -(-(j + 2) * slots // a), s, j + 1))
    return out


def targets(totals: dict[str, int], weights: dict[str, float] | None = None, temperature: float = 0.5) -> dict[str, float]:
    """Target weights of counted sources; ``pfair_mix`` says which source gets which."""
    target = {s: float(n) ** temperature for s, n in totals.items()}
    if weights:
        named = {s: float(w) for s, w in weights.items() if s in totals and w > 0}
        others = [s for s in totals if s not in named]
        left = max(1.0 - sum(named.values()), 0) or min(named.values(), default=1.0)
        whole = sum(target[s] for s in others)
        target = named | {s: left * target[s] / whole for s in others}
    return target


def lane_of(source_col: str) -> Column:
    """Name of the row's source; null and empty sources are one."""
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def target_weights(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, source_col: str = "source") -> dict[str, float]:
    """The target weights that ``pfair_mix`` holds the sources of ``docs`` to."""
    counts = docs.groupBy(lane_of(source_col).alias("lane")).agg(F.count("*").alias("n"))
    return targets({r["lane"]: r["n"] for r in counts.collect()}, weights, temperature)  # one row per source


def _keyed(docs: DataFrame, kept: list[str], id_col: str, source_col: str) -> DataFrame:
    """(lane, k, h, row): in a lane rows go by (k, h), the id and a hash of the row; null ids lie spread below all ids."""
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    own, h = F.col(id_col).cast("long"), F.xxhash64(*hashed)
    below = -(1 << 62) - F.pmod(h, F.lit(1 << 61))
    return docs.select(lane_of(source_col).alias("lane"), F.coalesce(own, below).alias("k"), h.alias("h"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))


def pfair_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    block_docs: int = 16,
    slots: int = SLOTS,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """All rows and columns in the mixed order, with block_no, release, deadline, slot and in_block.

    The mixed order is (slot, in_block), over partitions and within them. ``weights`` names target weights; a
    source without one, and every source if None, gets its number of documents to the power ``temperature``
    (among the unnamed ones of the total that is left, or the smallest named weight). ``held`` says to which
    whole numbers a run holds them. Every source is scheduled by itself, whatever their number; one row per
    source and the slots of one cycle (at most ``slots``, or four for each source if that is more) pass through
    the driver. Null and empty sources are one source ''.
    Rows with a null id come first in their source; rows of one id follow each other by a hash of the row.
    Columns of the input named like the new ones are replaced; an empty input gives an empty result.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in NEW]
    keyed = _keyed(docs, kept, id_col, source_col)
    narrow = scratch.write(keyed.select("lane", "k", "h"), "keys")
    block = blocks_of(narrow, "k")
    # Written: Catalyst may hand a join key that is a folded array on to the side that lacks its columns.
    narrow = scratch.write(narrow.withColumn("blk", block("k")), "blocks")
    counts = scratch.write(narrow.groupBy("lane", "blk").agg(F.count("*").alias("n")), "counts")
    totals = {r["lane"]: r["n"] for r in counts.groupBy("lane").agg(F.sum("n").alias("n")).collect()}  # one row per source
    target = targets(totals, weights, temperature)
    share = held(target, slots)
    length = sum(share.values())
    at: dict[tuple[str, int], list[int]] = defaultdict(list)
    for s, j, _, _, slot in cycle(share):
        at[s, j // PER_ROW].append(slot)
    sizes = spark.createDataFrame(list(share.items()), "lane string, share long")
    plan = spark.createDataFrame([(*key, x) for key, x in at.items()], "lane string, part long, at array<int>")

    def slot_of(rows: DataFrame, i: Column) -> DataFrame:
        """The rows with block_no, cycle, j and slot of the row numbered i (from 0) in its lane."""
        rows = join_small(rows.withColumn("i", i), sizes, "lane", "inner", len(share), 100)
        rows = rows.withColumn("block_no", F.floor(F.col("i") / block_docs)).withColumn("j", F.col("block_no") % F.col("share"))
        rows = rows.withColumn("cycle", F.floor(F.col("block_no") / F.col("share"))).withColumn("part", F.floor(F.col("j") / PER_ROW))
        rows = join_small(rows, plan, ["lane", "part"], "inner", len(at), 100 + 4 * PER_ROW)
        return rows.withColumn("slot", F.col("cycle") * length + F.get("at", (F.col("j") % PER_ROW).cast("int"))).drop("at", "part")

    ahead = Window.partitionBy("lane").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("lane", "blk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    ties = F.rank().over(Window.partitionBy("lane", "blk").orderBy("k", "h"))  # equal rows must not part
    ranked = narrow.withColumn("r", ties).join(starts, ["lane", "blk"])
    ranked = scratch.write(slot_of(ranked, F.col("start") + F.col("r") - 1).select("lane", "k", "h", "i", "slot"), "ranked")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(ranked, "slot", 1, parts)
    parts = len(cuts) + 1
    p = last_at_most(F.lit(cuts), F.col("slot")) if cuts else F.lit(0)
    edge = ranked.withColumn("p", p).groupBy("lane", "p").agg(F.min(F.struct("k", "h")).alias("low"), F.min("i").alias("start"))
    edges = edge.groupBy("lane").agg(F.sort_array(F.collect_list(F.struct("low", "p", "start"))).alias("edges"))
    edges = scratch.write(edges.select("lane", F.col("edges.low").alias("lows"), F.col("edges.p").alias("ps"), F.col("edges.start").alias("begins")), "edges")
    own = join_small(keyed, edges, "lane", "inner", len(share) * parts, 40)
    own = own.withColumn("e", last_at_most(F.col("lows"), F.struct("k", "h")) - 1)
    own = own.select("lane", "k", "h", "row", F.get("ps", F.col("e")).alias("p"), F.get("begins", F.col("e")).alias("begin"))
    dealt = own.repartitionById(parts, "p")
    no = F.row_number().over(Window.partitionBy("p", "lane").orderBy("k", "h"))
    placed = slot_of(dealt.withColumn("no", no).drop("k", "h"), F.col("begin") + F.col("no") - 1)
    if not (is_small(len(share), 100) and is_small(len(at), 100 + 4 * PER_ROW)):  # joined by shuffle
        placed = placed.repartitionById(parts, "p")
    base = F.col("cycle") * length
    return placed.withColumn("in_block", F.col("i") % block_docs).sortWithinPartitions("slot", "in_block").select(
        *(F.col(f"row.`{c}`").alias(c) for c in kept),
        "block_no",
        (base + F.floor(F.col("j") * length / F.col("share"))).alias("release"),
        (base + F.ceil((F.col("j") + 1) * length / F.col("share"))).alias("deadline"),
        "slot",
        "in_block",
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows with their own columns only, partitioned and sorted into the mixed order."""
    id_col, source_col = options.pop("id_col", "doc_id"), options.pop("source_col", "source")
    whole = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    return pfair_mix(whole, **options).select("all.*")
