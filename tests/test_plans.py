"""Range blocks, checked joins and scratch tables."""

from bisect import bisect_right
from collections import Counter

from pyspark.sql import functions as F

from quire.plans import blocks, scratch
from quire.plans.blocks import block_of, splitters
from quire.plans.joins import MOST_BYTES, is_small, join_small, without


def test_blocks_follow_the_splitters(spark):
    cuts = [-5, 0, 7, 8, 100, 2**40]
    values = [None, -(2**62), -6, -5, -1, 0, 6, 7, 8, 9, 99, 100, 2**40, 2**62]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", block_of("v", cuts).alias("b")).collect()
    assert all(r["b"] == (0 if r["v"] is None else bisect_right(cuts, r["v"])) for r in got)
    assert spark.range(3).select(block_of("id", []).alias("b")).distinct().first()["b"] == 0


def test_splitters_cut_evenly(spark):
    df = spark.range(20_000).select((F.col("id") * F.col("id")).alias("k"))
    cuts = splitters(df, "k", rows_per_block=1000)
    sizes = [r["count"] for r in df.groupBy(block_of("k", cuts)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1300
    assert splitters(df.limit(10), "k") == []
    assert splitters(df.where("false"), "k") == []


def test_blocks_follow_the_keys_at_any_number(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MOST_CUTS", 8)
    df = spark.range(20_000).select((F.col("id") * 3 - 30_000).alias("k")).union(spark.sql("select null"))
    got = df.select("k", blocks.blocks_of(df, "k", 50)("k").alias("b")).collect()
    rows = sorted((r["k"], r["b"]) for r in got if r["k"] is not None)
    assert all(x[1] <= y[1] for x, y in zip(rows, rows[1:]))
    sizes = Counter(b for _, b in rows)
    assert len(sizes) > 300 and max(sizes.values()) < 100 and [r["b"] for r in got if r["k"] is None] == [0]
    assert df.limit(5).select(blocks.blocks_of(df.limit(5), "k")("k")).distinct().count() == 1


def test_last_at_most_is_a_binary_search(spark):
    edges = [(1, "b"), (4, "a"), (4, "c"), (9, "a")]
    keys = [(0, "z"), (1, "a"), (1, "b"), (4, "b"), (4, "c"), (9, "a"), (10, "")]
    df = spark.createDataFrame([(edges, k) for k in keys], "e array<struct<a:int,b:string>>, k struct<a:int,b:string>")
    got = [r["n"] for r in df.select(blocks.last_at_most(F.col("e"), F.col("k")).alias("n")).collect()]
    assert got == [bisect_right(edges, k) for k in keys]


def test_join_is_broadcast_only_when_small(spark):
    a, b = spark.range(10), spark.range(5)

    def plan(rows, size):
        return join_small(a, b, "id", "inner", rows, size)._jdf.queryExecution().logical().toString()

    assert "broadcast" in plan(5, 16).lower() and "broadcast" not in plan(5, MOST_BYTES).lower()


def test_a_broadcast_is_bounded_as_a_table_in_memory():
    """Narrow rows take several times their own bytes: millions of them must not pass through the driver."""
    assert is_small(400_000, 8) and not is_small(1_000_000, 8) and not is_small(600_000, 0)


def test_without_takes_any_column_names(spark):
    docs = spark.createDataFrame([(1, "a", 1), (None, "b", 2), (2, None, 3), (1, "a", 4)], "k0 int, row string, k1 int")
    gone = spark.createDataFrame([(1, "a"), (None, "b")], "k0 int, k1 string")
    left = without(docs, [F.col("k0"), F.col("row")], gone, 2)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, None, 3)]


def test_scratch_is_read_back_and_bounds_arrow(spark):
    df = scratch.write(spark.range(3).select("id", F.array("id").alias("a")), "x")
    assert df.count() == 3 and df.columns == ["id", "a"] and spark.conf.get(scratch.ARROW_BYTES) == f"{scratch.MOST_ARROW_BYTES}b"
    assert scratch.shared_dir(spark) in df.inputFiles()[0] or df.inputFiles()[0].startswith("file:")
