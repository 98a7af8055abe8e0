"""Reading folders of files and writing reports."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import csvtext
from quire.functions.text import csv_field
from quire.operators.arrange import numbers_taken
from quire.plans.blocks import free_number

# What a folder is searched for.
EXTENSIONS = {"pdf", "png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp", "csv", "tsv", "txt", "html", "htm", "doc", "docx", "rtf", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp"}


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, ext, length, content) of a folder's accepted files; not its subfolders."""
    files = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/*")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), ext.alias("ext"), "length", "content").where(F.col("ext").isin(*EXTENSIONS))


def csv_rows(files: DataFrame) -> DataFrame:
    """(path, row_no, cells, error) of delimited text files; a bad file is one row with its error."""

    @F.pandas_udf("struct<rows:array<array<string>>,error:string>")
    def read(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
        out = []
        for data, kind in zip(content, ext, strict=True):
            try:
                text = csvtext.decode(data)
                out.append((csvtext.parse(text, "\t" if kind == "tsv" else csvtext.sniff(text)), None))
            except ValueError as e:
                out.append(([[]], str(e)))
        return pd.DataFrame(out, columns=["rows", "error"])

    got = files.where(F.col("ext").isin("csv", "tsv", "txt")).select("path", read("content", "ext").alias("r"))
    rows = got.select("path", F.posexplode("r.rows").alias("pos", "cells"), "r.error")
    return rows.select("path", (F.col("pos") + 1).alias("row_no"), "cells", "error")


def csv_text(cells: DataFrame, key: str = "page") -> DataFrame:
    """(key, csv): quoted fields with CRLF ends, tables of one key apart by an empty line."""
    row = cells.groupBy(key, "table_no", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", csv_field(F.col("text")).alias("f")))).alias("c"))
    line = F.array_join(F.transform("c", lambda x: x["f"]), ",")
    table = row.groupBy(key, "table_no").agg(F.sort_array(F.collect_list(F.struct("row_no", line.alias("l")))).alias("r"))
    body = F.concat(F.array_join(F.transform("r", lambda x: x["l"]), "\r\n"), F.lit("\r\n"))
    return table.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_no", body.alias("b")))), lambda x: x["b"]), "\r\n").alias("csv"))


def unique_names(files: DataFrame) -> DataFrame:
    """(name, ord, unique): 'x.pdf', 'x (2).pdf', ... for names given more than once, never a name that is given."""
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)?$", 1)
    parts = files.select("name", "ord", stem.alias("stem"), ext.alias("ext"), F.lower(stem).alias("low"), F.lower(ext).alias("low_ext"))
    k = F.row_number().over(Window.partitionBy("low", "low_ext").orderBy("ord"))
    taken = numbers_taken(parts.select("low_ext", "low"), "low_ext", "low", r"^(.*) \(([1-9][0-9]{0,8})\)$")
    named = parts.withColumn("k", k).join(taken, ["low_ext", "low"], "left")
    fresh = F.concat("stem", F.lit(" ("), free_number(F.col("k"), F.col("taken")).cast("string"), F.lit(")"), "ext")
    return named.select("name", "ord", F.when(F.col("k") == 1, F.col("name")).otherwise(fresh).alias("unique"))


def write_reports(reports: DataFrame, path: str, column: str = "report") -> None:
    """Write a column of report texts (JSON texts are one line each) as text files below ``path``."""
    reports.select(column).write.text(path)


def guard_output(inputs: list[str], out: str) -> None:
    """Raise ValueError if ``out`` is one of the inputs, also by another spelling or link."""
    if os.path.realpath(out) in {os.path.realpath(p) for p in inputs}:
        raise ValueError(f"{out} is also an input; choose another name")
