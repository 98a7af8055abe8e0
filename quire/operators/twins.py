"""Objects that are equal once their references point at first copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import scratch
from quire.plans.joins import join_small


def prefixed(value: Column) -> Column:
    """``-`` for null, else length, colon, value: no two lists of values give one text."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def forms(objects: DataFrame, refs: DataFrame, body: list[str]) -> DataFrame:
    """(id, form): all of an object in one text, its columns ``body`` and then its references by slot."""
    target = F.concat(prefixed(F.col("slot")), F.col("dst").cast("string"), F.lit(";"))
    listed = refs.groupBy(F.col("src").alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "dst", target.alias("t")))), lambda r: r["t"]), "").alias("r"))
    own = F.concat(*(prefixed(F.col(c)) for c in body))
    return objects.join(listed, F.col("id") == F.col("s"), "left").select("id", F.concat(own, F.lit("|"), F.coalesce("r", F.lit(""))).alias("form"))


def _twins(found: DataFrame) -> DataFrame:
    """(id, first) of objects whose form an object before them has; hashes find them, whole forms decide."""
    hashed = scratch.write(found.withColumn("h", F.xxhash64("form")), "forms")
    several = scratch.write(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("k")), "several")
    rows = scratch.write(join_small(hashed, several, F.col("h") == F.col("k"), "left_semi", several.count(), 8), "candidates")
    firsts = scratch.write(rows.groupBy("h", "form").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    size = firsts.agg(F.count("*").alias("n"), F.max(F.octet_length("form")).alias("b")).first()
    firsts = firsts.select(F.col("h").alias("k"), F.col("form").alias("f"), "first")
    same = (F.col("h") == F.col("k")) & (F.col("form") == F.col("f"))
    return join_small(rows, firsts, same, "inner", size["n"], 16 + (size["b"] or 0)).where("id != first").select("id", "first")


def merge_twins(objects: DataFrame, refs: DataFrame, body: list[str], most_rounds: int | None = 4) -> DataFrame:
    """(id, keep_id, round): objects that equal an object before them, the one that stays, and the round that found it.

    ``objects`` has a unique number id, columns ``body`` (all that is compared besides references) and may have
    ``eligible``: only such objects are merged, references of all are rewritten. ``refs`` are (src, slot, dst). A round
    points references at first copies and compares what follows, so merging one layer makes the next one equal;
    rounds end when nothing changes, or after ``most_rounds`` (None: never before that). Two objects are equal if
    their whole forms are: slots and targets in order, nulls apart from empty texts. A reference to nothing stays as
    it is. One row an object moves in each round; an object's references are one list.
    """
    eligible = F.coalesce("eligible", F.lit(False)) if "eligible" in objects.columns else F.lit(True)
    own = scratch.write(objects.select("id", eligible.alias("eligible"), *body), "objects")
    refs = refs.select("src", "slot", "dst")
    kept, rounds = None, 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        twins = scratch.write(_twins(forms(own.where("eligible").drop("eligible"), refs, body)), "twins")
        if not (n := twins.count()):
            break
        gone = twins.select(F.col("id").alias("x"), F.col("first").alias("to"))
        own = scratch.write(join_small(own, gone, F.col("id") == F.col("x"), "left_anti", n), "objects")
        moved = join_small(join_small(refs, gone, F.col("src") == F.col("x"), "left_anti", n), gone, F.col("dst") == F.col("x"), "left", n)
        refs = scratch.write(moved.select("src", "slot", F.coalesce("to", "dst").alias("dst")), "refs")
        new = twins.select("id", F.col("first").alias("keep_id"), F.lit(rounds).alias("round"))
        if kept is not None:  # what was kept so far may have gone now
            now = join_small(kept, gone, F.col("keep_id") == F.col("x"), "left", n)
            new = now.select("id", F.coalesce("to", "keep_id").alias("keep_id"), "round").union(new)
        kept = scratch.write(new, "kept")
    return kept if kept is not None else objects.select("id", F.col("id").alias("keep_id"), F.lit(0).alias("round")).limit(0)
