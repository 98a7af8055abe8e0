"""Joins whose broadcast is decided by a counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 32 << 20
#: What a row takes in a broadcast table beside its own bytes: its header, and hash slots that are at most half full.
ROW_COST = 56


def is_small(rows: int, row_bytes: int = 16) -> bool:
    """Whether that many rows of at most ``row_bytes`` bytes may be broadcast: they pass through the driver's memory."""
    return rows * (row_bytes + ROW_COST) <= MOST_BYTES


def join_small(left: DataFrame, right: DataFrame, on, how: str, right_rows: int, row_bytes: int = 16) -> DataFrame:
    """Join with ``right`` broadcast if its rows, of about ``row_bytes`` bytes, fit MOST_BYTES as a table in memory, else by shuffle."""
    return left.join(F.broadcast(right) if is_small(right_rows, row_bytes) else right, on, how)


def without(docs: DataFrame, keys: list[Column], gone: DataFrame, gone_rows: int, row_bytes: int = 16) -> DataFrame:
    """The rows of ``docs`` whose keys are not rows of ``gone``; null keys compare equal.

    No column of ``docs`` can clash with a name used here, and its columns come back as they are.
    """
    names = [f"k{i}" for i in range(len(keys))]
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(k.alias(n) for k, n in zip(keys, names, strict=True))).alias("l")
    gone = gone.toDF(*names).alias("r")
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return join_small(wrapped, gone, same, "left_anti", gone_rows, row_bytes).select("row.*")
