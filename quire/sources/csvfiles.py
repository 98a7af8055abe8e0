"""A sink that writes each row as one file of delimited text: a data source with commit and abort.

``df.write.format("csv_files").mode("append").option("bom", "true").save(path)`` takes rows (name, csv). Tasks write
below a folder of their job; the commit moves whole files to their names, and an abort, or a task that fails,
leaves nothing. Folders are what pyarrow's file systems open; driver and executors must see the same one.
"""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

from quire.functions.text import csv_field

MARK = b"\xef\xbb\xbf"


def open_folder(path: str):
    """(file system, folder) of a local path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: its folder, and the names of its files."""

    folder: str
    names: list[str]


class CsvFilesWriter(DataSourceWriter):
    def __init__(self, path: str, bom: bool):
        self.path, self.bom, self.job = path, bom, uuid.uuid4().hex

    def _job(self, root: str) -> str:
        return f"{root}/_job-{self.job}"

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = open_folder(self.path)
        folder, names = f"{self._job(root)}/{uuid.uuid4().hex}", []
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"{name!r} can't be a file's name here")
            if name in names:
                raise ValueError(f"{name} is given more than once")
            if not names:
                fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{name}") as out:
                out.write((MARK if self.bom else b"") + (row["csv"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = open_folder(self.path)
        done = [m for m in messages if m is not None]
        every = [n for m in done for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("a file's name is given more than once")
        fs.create_dir(root, recursive=True)
        for m in done:
            for name in m.names:
                fs.move(f"{m.folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = open_folder(self.path)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(self._job(root))


class CsvFiles(DataSource):
    """Write-only: rows (name, csv); options ``path`` and ``bom``."""

    @classmethod
    def name(cls) -> str:
        return "csv_files"

    def writer(self, schema, overwrite: bool) -> CsvFilesWriter:
        if missing := {"name", "csv"} - set(schema.fieldNames()):
            raise ValueError(f"the rows have no {', '.join(sorted(missing))}")
        return CsvFilesWriter(self.options["path"], self.options.get("bom", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CsvFiles)


def table_files(cells: DataFrame, delimiter: str = ",", single_file: bool = False) -> DataFrame:
    """(name, csv): a file for each table of cells (file, page, table_no, row_no, col_no, text), or one for each file.

    Tables are counted within their page. Fields are quoted where they must be, lines end with CRLF; in a single file
    tables stand apart by an empty line. Missing cells between others are empty; a null text is empty.
    """
    at, lines = ["file", "page", "table_no"], ["file", "page", "table_no", "row_no"]
    fields = F.struct("col_no", csv_field(F.coalesce("text", F.lit("")), delimiter).alias("f"))
    rows = cells.groupBy(*lines).agg(F.collect_list(fields).alias("c"), F.max("col_no").alias("n"))
    by_col = F.map_from_entries("c")
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.coalesce(by_col[k], F.lit(""))), delimiter)
    tables = rows.select(*lines, line.alias("l")).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("row_no", "l"))).alias("r"))
    body = F.concat(F.array_join(F.transform("r", lambda r: r["l"]), "\r\n"), F.lit("\r\n"))
    if single_file:
        whole = tables.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "table_no", body.alias("b")))).alias("t"))
        return whole.select(F.concat("file", F.lit("-tables.csv")).alias("name"), F.array_join(F.transform("t", lambda t: t["b"]), "\r\n").alias("csv"))
    k: Column = F.row_number().over(Window.partitionBy("file", "page").orderBy("table_no"))
    return tables.select(F.concat("file", F.lit("-p"), "page", F.lit("-t"), k.cast("string"), F.lit(".csv")).alias("name"), body.alias("csv"))
