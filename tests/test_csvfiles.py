"""The sink of one file per table: read back, marks, and what a failed task leaves."""

import os

import pytest
from pyspark.sql import functions as F

from quire.functions import csvtext
from quire.sources import csvfiles


def cells(spark):
    rows = [("a", 1, 5, 1, 1, "x, y"), ("a", 1, 5, 1, 3, ' "q" '), ("a", 1, 5, 2, 1, "line\r\nbreak"), ("a", 1, 9, 1, 1, None), ("a", 2, 1, 1, 1, "é漢"), ("b", 1, 1, 1, 1, "only")]
    return spark.createDataFrame(rows, "file string, page int, table_no int, row_no int, col_no int, text string")


def test_files_are_read_back_equal(spark, tmp_path):
    csvfiles.register(spark)
    made = csvfiles.table_files(cells(spark))
    made.repartition(3).write.format("csv_files").mode("append").option("bom", "true").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a-p1-t1.csv", "a-p1-t2.csv", "a-p2-t1.csv", "b-p1-t1.csv"]
    data = (tmp_path / "out" / "a-p1-t1.csv").read_bytes()
    assert data.startswith(csvfiles.MARK) and csvtext.parse(csvtext.decode(data), ",") == [["x, y", "", ' "q" '], ["line\r\nbreak"]]
    assert (tmp_path / "out" / "b-p1-t1.csv").read_bytes() == csvfiles.MARK + b"only\r\n"
    single = {r["name"]: r["csv"] for r in csvfiles.table_files(cells(spark), ";", True).collect()}
    assert single["a-tables.csv"] == 'x, y;;" ""q"" "\r\n"line\r\nbreak"\r\n\r\n\r\n\r\né漢\r\n'


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    csvfiles.register(spark)
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("x").alias("csv"))
    with pytest.raises(Exception, match="lost"):
        rows.repartition(4, "id").write.format("csv_files").mode("append").save(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or not os.listdir(tmp_path / "out")
    for bad in ("../x", "", None, "_x"):
        with pytest.raises(Exception, match="can't be"):
            spark.createDataFrame([(bad, "x")], "name string, csv string").write.format("csv_files").mode("append").save(str(tmp_path / "out"))


def test_two_files_of_one_name_are_refused(spark, tmp_path):
    csvfiles.register(spark)
    with pytest.raises(Exception, match="more than once"):
        spark.range(4).selectExpr("'same' as name", "'x' as csv").repartition(4).write.format("csv_files").mode("append").save(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or not os.listdir(tmp_path / "out")
