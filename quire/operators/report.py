"""Reports and estimates: conditional counts, medians, boxes, samples, permissions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Permission bits of an encrypted document.
PERMISSIONS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill": 256, "accessible": 512, "assemble": 1024, "print_fine": 2048}


def strip_report(rows: DataFrame, kind: str, kinds: list[str], name: str) -> DataFrame:
    """One row: a count per kind in one pass, and the number of distinct names."""
    return rows.agg(*(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds), F.count_distinct(name).alias("n_names"))


def permission_bits(flags: dict[str, Column]) -> Column:
    """Sum of the bits of the granted permissions."""
    out = F.lit(0)
    for name, granted in flags.items():
        out = out.bitwiseOR(F.when(granted, F.lit(PERMISSIONS[name])).otherwise(F.lit(0)))
    return out


def sampled_ratio(items: DataFrame, group: str, order: list[str], size: str, reduced: str, most: int = 12) -> DataFrame:
    """(group, total, sampled, estimate): every ceil(n / most)-th item is measured and its ratio applied to all."""
    n = F.count("*").over(Window.partitionBy(group))
    rows = items.withColumn("_n", n).withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    taken = (F.col("_rn") - 1) % F.ceil(F.col("_n") / most) == 0
    sums = rows.groupBy(group).agg(
        F.sum(size).alias("total"),
        F.count_if(taken).alias("sampled"),
        F.sum(F.when(taken, F.col(size))).alias("_s"),
        F.sum(F.when(taken, F.col(reduced))).alias("_r"),
    )
    return sums.select(group, "total", "sampled", F.least("total", F.col("total") * F.col("_r") / F.col("_s")).alias("estimate"))


def bounding_box(words: DataFrame, key: str) -> DataFrame:
    return words.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def fill_pages(rows: DataFrame, key: str, order: str, height: str, room: float, head: float = 0.0) -> DataFrame:
    """(key, order, page): rows set on pages of ``room``; the header takes ``head`` of each, a page holds one row at least.

    Rows of a null height leave the rest of their key on one page. A key's rows are folded one by one as they come in
    order, by a task that holds none of them.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, page, used = [], 1, head
        for batch in batches:
            pages = []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != [k]:
                    at, page, used = [k], 1, head
                total = None if used is None or h is None else used + h
                if total is not None and not total <= room and not used <= head:
                    page, total = page + 1, head + h
                used = total
                pages.append(page)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.int32())], names=[key, order, "page"])

    ordered = rows.select(key, order, F.col(height).cast("double").alias("_h")).repartition(key).sortWithinPartitions(key, order, "_h")
    return ordered.mapInArrow(fold, f"`{key}` {types[key]}, `{order}` {types[order]}, page int")
