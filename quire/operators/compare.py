"""Comparing two versions of a document by page and line."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_texts(lines: DataFrame, name: str) -> DataFrame:
    """(doc_id, page_no, name): the lines of each page in order, as an array."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc_id", "page_no").agg(F.transform(ordered, lambda x: x["text"]).alias(name))


def presence(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, page_no, presence, text_changed): pages paired by number; one full outer join."""
    both = page_texts(old, "old").join(page_texts(new, "new"), ["doc_id", "page_no"], "full")
    return both.select(
        "doc_id",
        "page_no",
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("both").alias("presence"),
        (~F.col("old").eqNullSafe(F.col("new"))).alias("text_changed"),
    )


def lcs_diff(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """(removed, added) lines of a shortest edit script: the ends that agree are cut, the rest aligned."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    removed, added, i, j = [], [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and table[i + 1][j] >= table[i][j + 1]):
            removed.append(a[i])
            i += 1
        else:
            added.append(b[j])
            j += 1
    return removed, added


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, page_no, removed, added) of the pages that changed; equal pages never reach Python."""
    empty = F.array().cast("array<string>")
    both = page_texts(old, "old").join(page_texts(new, "new"), ["doc_id", "page_no"], "full")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", "page_no", *(F.coalesce(c, empty).alias(c) for c in ("old", "new")))

    @F.pandas_udf("struct<removed:array<string>,added:array<string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lcs_diff(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["removed", "added"])

    return changed.select("doc_id", "page_no", diff("old", "new").alias("d")).select("doc_id", "page_no", "d.*")


def summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, changed_pages, removed_lines, added_lines, identical) per document."""
    docs = old.select("doc_id").union(new.select("doc_id")).distinct()
    changes = line_diff(old, new).groupBy("doc_id").agg(
        F.sort_array(F.collect_list("page_no")).alias("pages"),
        F.sum(F.size("removed")).alias("removed_lines"),
        F.sum(F.size("added")).alias("added_lines"),
    )
    return docs.join(changes, "doc_id", "left").select(
        "doc_id",
        F.coalesce(F.array_join("pages", ","), F.lit("")).alias("changed_pages"),
        F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"),
        F.coalesce("added_lines", F.lit(0)).alias("added_lines"),
        F.col("pages").isNull().alias("identical"),
    )


def unified_diff(old: DataFrame, new: DataFrame, context: int = 2) -> DataFrame:
    """(doc_id, page_no, diff): of each page that changed, a unified diff with ``context`` lines around changes."""
    empty = F.array().cast("array<string>")
    both = page_texts(old, "old").join(page_texts(new, "new"), ["doc_id", "page_no"], "full")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", "page_no", *(F.coalesce(c, empty).alias(c) for c in ("old", "new")))

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        hunks = (difflib.unified_diff(list(x), list(y), n=context, lineterm="") for x, y in zip(a, b, strict=True))
        return pd.Series(["\n".join(list(h)[2:]) for h in hunks])  # without the two lines of file names

    return changed.select("doc_id", "page_no", diff("old", "new").alias("diff"))


def page_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old_pages, new_pages, changed, report): page counts, changed pages in order, and all as one JSON text."""
    found = presence(old, new).groupBy("doc_id").agg(
        F.count_if(F.col("presence") != "added").alias("old_pages"),
        F.count_if(F.col("presence") != "removed").alias("new_pages"),
        F.array_sort(F.collect_list(F.when(F.col("text_changed"), F.col("page_no")))).alias("changed"),
    )
    return found.withColumn("report", F.to_json(F.struct("doc_id", "old_pages", "new_pages", "changed")))


def text_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, report): how many pages each version has and which differ, then their unified diffs in page order."""
    diffs = unified_diff(old, new).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "diff"))).alias("diffs"))
    found = page_report(old, new).join(diffs, "doc_id", "left")
    listed = F.when(F.size("changed") > 0, F.concat(F.lit("changed: "), F.array_join(F.col("changed").cast("array<string>"), ", "))).otherwise("nothing changed")
    head = F.concat_ws("; ", F.concat(F.col("old_pages").cast("string"), F.lit(" before")), F.concat(F.col("new_pages").cast("string"), F.lit(" after")), listed)
    pages = F.transform(F.coalesce("diffs", F.array().cast("array<struct<page_no:int,diff:string>>")), lambda d: F.concat(F.lit("--- "), d["page_no"].cast("string"), F.lit("\n"), d["diff"]))
    return found.select("doc_id", F.concat(F.array_join(F.concat(F.array(head), pages), "\n"), F.lit("\n")).alias("report"))
