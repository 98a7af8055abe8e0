"""Exact deduplication by content sort, in DataFrame operations only.

1. Sampled splitters range-partition the normalised texts: Spark's range exchange samples the keys, which are
   a bounded prefix of the bytes and, in place of the rest, a hash of the whole text. Keys of any one text
   are equal, so its copies meet in one partition.
2. There an external sort by (key, whole normalised text, identifier) places equal texts next to each other, and
   each row is compared in full with its predecessor. A run of equal texts keeps its largest identifier.
3. A text that may hold a third of all rows would be one partition. Keys that hold more than HOT_BYTES (found by
   counting hashes) get the identifier's block, or the task they came from, as a last part. Their copies are then
   runs in several partitions; the runs' boundary texts, one for each, are compared in full with each other, and
   runs of one text are joined.

No digest decides anything: SHA-256 is only returned, and texts whose hashes collide are still told apart by the
comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans import scratch
from quire.plans.joins import join_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64
HOT_BYTES = 16 << 20
ROW_BYTES = 200  # of a row besides its text
ID_BITS = 8


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` does the same on ASCII, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def text_hash(norm: Column) -> Column:
    """Stands in the sort key for the part of a text beyond its prefix."""
    return F.xxhash64(norm)


def _runs(docs: DataFrame, id_col: str, text_col: str, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sorted rows with their run's head, and the joined runs of hot texts.

    Rows: row (the columns ``kept``), doc_id, sha (of the text), head (the first of its run), hot, keep_id and
    group_size (of its run), and key, part, run, which name the run. Joined runs: key, part, run, all_id, all_size,
    best (whether the run holds the row that stays).
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        norm.alias("norm"),
    ).withColumn("h", text_hash(F.col("norm")))
    size = F.sum(F.octet_length("norm") + ROW_BYTES)
    hot = scratch.write(rows.groupBy("h").agg(size.alias("size")).where(F.col("size") > HOT_BYTES).select(F.col("h").alias("hot_h")), "hot")
    rows = join_small(rows, hot, F.col("h") == F.col("hot_h"), "left", hot.count(), 8).withColumn("hot", F.col("hot_h").isNotNull()).drop("hot_h")
    # Null ids have no block: the task that a row comes from stands in for it.
    block = F.coalesce(F.shiftright("doc_id", ID_BITS), -1 - F.spark_partition_id())
    rows = rows.withColumn("part", F.when(F.col("hot"), block).otherwise(0)).withColumn("prefix", F.substring("norm", 1, PREFIX_CHARS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "prefix", "h", "part")
    same_key = Window.partitionBy("prefix", "h", "part").orderBy("norm", F.col("doc_id").desc_nulls_last())
    before = F.lag("norm").over(same_key)
    marked = ordered.withColumn("head", before.isNull() | (before != F.col("norm")))
    marked = marked.withColumn("run", F.sum(F.col("head").cast("int")).over(same_key.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.select(
        "row", "doc_id", "h", "prefix", "part", "run", "head", "hot",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.when(F.col("head") & F.col("hot"), F.col("norm")).alias("edge"),
    )
    run = Window.partitionBy("prefix", "h", "part", "run")
    runs = marked.withColumn("keep_id", F.max("doc_id").over(run)).withColumn("group_size", F.count("*").over(run))
    runs = scratch.write(runs.withColumn("key", F.struct("prefix", "h")).drop("prefix", "h"), "runs")
    edges = runs.where("hot and head").select("key", "part", "run", "edge", "keep_id", "group_size")
    joined = edges.groupBy("edge").agg(
        F.max("keep_id").alias("all_id"),
        F.sum("group_size").alias("all_size"),
        F.max_by(F.struct("key", "part", "run"), F.struct("keep_id", "part", "key", "run")).alias("best"),
    )
    joined = edges.select("key", "part", "run", "edge").join(joined, "edge")
    joined = joined.select("key", "part", "run", "all_id", "all_size", (F.col("best") == F.struct("key", "part", "run")).alias("best"))
    return runs, scratch.write(joined, "joined")


def _judged(docs: DataFrame, id_col: str, text_col: str, kept: list[str]) -> DataFrame:
    """Every row with keep_id, group_size and stays, over joined runs."""
    runs, joined = _runs(docs, id_col, text_col, kept)
    calm = runs.where("not hot").select("row", "doc_id", "sha", "keep_id", "group_size", F.col("head").alias("stays"))
    same = F.lit(True)
    for c in ("key", "part", "run"):
        same = same & (F.col(f"r.{c}") == F.col(f"j.{c}"))
    hot = join_small(runs.where("hot").drop("keep_id", "group_size").alias("r"), joined.alias("j"), same, "inner", joined.count(), 400)
    hot = hot.select("row", "doc_id", "sha", F.col("all_id").alias("keep_id"), F.col("all_size").alias("group_size"), (F.col("head") & F.col("best")).alias("stays"))
    return calm.union(hot)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Rows with a null id belong to their group but are never chosen
    while another id exists; of a group with null ids only, keep_id is null and one row is kept.
    Repeated rows with one id and one text count one by one; exactly one row of a group is kept.
    An empty input gives an empty result; other columns are ignored.
    """
    return _judged(docs, id_col, text_col, []).select("doc_id", "keep_id", "group_size", F.col("stays").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest id.

    Rows with a null id stay only if their whole group has none (then all of them stay). Rows that repeat
    an id with another text are other rows, judged by their own text. Whole rows move once, in the sort.
    """
    stays = _judged(docs, id_col, text_col, docs.columns).where("stays or keep_id is null")
    return stays.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
