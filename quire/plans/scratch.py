"""Scratch tables in the folder that driver and executors share.

A scratch table cuts lineage: it is written once as Parquet and read back, so a lost executor
costs a re-read and never a recomputation. The folder is ``spark.checkpoint.dir``; only on a local master
a temporary folder of this machine stands in for it.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a local folder where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="quire-"))
    return _fallback[0]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_ARROW_BYTES = 4 << 20


def bound_arrow(spark: SparkSession) -> None:
    """Let batches sent to Python hold at most MOST_ARROW_BYTES, whatever their rows are.

    Sets the session's limit once if it is higher and leaves it there, so that all threads see one value.
    """
    if int(spark.conf.get(ARROW_BYTES).rstrip("b")) > MOST_ARROW_BYTES:
        spark.conf.set(ARROW_BYTES, f"{MOST_ARROW_BYTES}b")


def write(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    bound_arrow(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone already
            delete(spark, path)
