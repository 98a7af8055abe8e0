"""Selecting, ordering, splitting, merging and imposing pages. All native; order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.blocks import free_number

from quire.functions.ranges import pages_of


def select_pages(docs: DataFrame, spec: str, rule: str = "keep") -> DataFrame:
    """(doc_id, ord, page_no) of a range over ``docs`` (doc_id, n_pages).

    ``rule``: keep order and repeats; 'first': a repeated page counts where it comes first; 'sorted': distinct
    pages in page order. Documents that the range does not fit are left out.
    """
    pages = pages_of(spec, F.col("n_pages"))
    if rule == "first":
        pages = F.array_distinct(pages)
    elif rule == "sorted":
        pages = F.array_sort(F.array_distinct(pages))
    return docs.select("doc_id", F.posexplode(pages).alias("pos", "page_no")).select("doc_id", (F.col("pos") + 1).alias("ord"), "page_no")


def split_every(docs: DataFrame, every: int) -> DataFrame:
    """(doc_id, part, page_no): parts of ``every`` pages."""
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page_no"))
    return pages.select("doc_id", (F.floor((F.col("page_no") - 1) / every) + 1).cast("int").alias("part"), "page_no")


def split_ranges(docs: DataFrame, specs: list[str]) -> DataFrame:
    """(doc_id, part, ord, page_no): one part for each range that fits."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), pages_of(s, F.col("n_pages")).alias("pages")) for i, s in enumerate(specs, 1)))
    each = docs.select("doc_id", F.explode(parts).alias("p"))
    return each.select("doc_id", "p.part", F.posexplode("p.pages").alias("pos", "page_no")).select(
        "doc_id", "part", (F.col("pos") + 1).alias("ord"), "page_no"
    )


def uncovered(docs: DataFrame, specs: list[str]) -> DataFrame:
    """(doc_id, page_no) in no part; array functions only, no join."""
    covered = F.flatten(F.array_compact(F.array(*(pages_of(s, F.col("n_pages")) for s in specs))))
    return docs.select("doc_id", F.explode(F.array_except(F.sequence(F.lit(1), "n_pages"), covered)).alias("page_no"))


def numbers_taken(names: DataFrame, key: str, name: str, form: str) -> DataFrame:
    """(key, name, taken): for names that others follow in a numbered form (base, number), the sorted numbers from 2 on."""
    found = names.distinct().where(F.col(name).rlike(form))
    split = found.select(key, F.regexp_extract(name, form, 1).alias(name), F.regexp_extract(name, form, 2).cast("long").alias("n"))
    return split.where("n > 1").groupBy(key, name).agg(F.sort_array(F.collect_list("n")).alias("taken"))


def part_names(groups: DataFrame, stem: Column, pattern: str = "{name}-{n}") -> DataFrame:
    """(doc_id, part, file): names of parts (doc_id, part, n_parts), numbers padded, clashes numbered.

    A clash takes the next number whose name no part of the document has.
    """
    from quire.functions.text import safe_name

    if "{n}" not in pattern:
        pattern = pattern + "-{n}"
    digits = F.char_length(F.col("n_parts").cast("string"))
    name = F.replace(F.replace(F.lit(pattern), F.lit("{name}"), stem), F.lit("{n}"), F.lpad(F.col("part").cast("string"), digits, F.lit("0")))
    named = groups.withColumn("base", safe_name(name))
    low = named.withColumn("low", F.lower("base"))
    k = F.row_number().over(Window.partitionBy("doc_id", "low").orderBy("part"))
    taken = numbers_taken(low.select("doc_id", "low"), "doc_id", "low", r"^(.*) \(([1-9][0-9]{0,8})\)$")
    fresh = F.concat(F.col("base"), F.lit(" ("), free_number(F.col("k"), F.col("taken")).cast("string"), F.lit(")"))
    return low.withColumn("k", k).join(taken, ["doc_id", "low"], "left").select("doc_id", "part", F.when(F.col("k") == 1, F.col("base")).otherwise(fresh).alias("file"))


def arrange(docs: DataFrame, order: str = "", delete: str | None = None, rotate: list[tuple[str, int]] = (), blank_after: list[int] = ()) -> DataFrame:
    """(doc_id, ord, page_no, copy, degrees): pages in order without deleted ones; blanks have page_no null.

    ``copy`` counts repeats of a page; rotations that hit a page add up modulo 360.
    """
    n = F.col("n_pages")
    pages = pages_of(order, n)
    if delete:
        pages = F.array_except(pages, pages_of(delete, n)) if order == "" else F.filter(pages, lambda p: ~F.array_contains(pages_of(delete, n), p))
    turned = F.lit(0)
    for spec, degrees in rotate:
        turned = turned + F.when(F.array_contains(pages_of(spec, n), F.col("page_no")), degrees).otherwise(0)
    rows = docs.select("doc_id", "n_pages", F.posexplode(pages).alias("pos", "page_no"))
    rows = rows.withColumn("degrees", F.pmod(turned, F.lit(360)).cast("int"))
    if blank_after:
        both = F.when(F.col("page_no").isin(list(blank_after)), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        rows = rows.withColumn("blank", F.explode(both))
        rows = rows.withColumn("degrees", F.when(F.col("blank"), 0).otherwise(F.col("degrees")))
    else:
        rows = rows.withColumn("blank", F.lit(False))
    place = Window.partitionBy("doc_id").orderBy("pos", "blank")
    copy = Window.partitionBy("doc_id", "page_no", "blank").orderBy("pos")
    return rows.select(
        "doc_id",
        F.row_number().over(place).alias("ord"),
        F.when(~F.col("blank"), F.col("page_no")).alias("page_no"),
        F.when(~F.col("blank"), F.row_number().over(copy)).alias("copy"),
        "degrees",
    )


def merge_starts(files: DataFrame, contents: bool = False, odd: bool = False, group: str = "source") -> DataFrame:
    """(group, file_ord, doc_id, n_pages, start_page) of files merged per group, by doc_id.

    With a contents page of one sheet the first file starts after it; ``odd`` starts every file on an odd
    page, so lengths count rounded up to even.
    """
    order = Window.partitionBy(group).orderBy("doc_id")

    def even(x: Column) -> Column:
        return x + x % 2 if odd else x

    lead = F.lit(1 if contents else 0)
    before = F.coalesce(F.sum(even(F.col("n_pages"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select(
        group,
        F.row_number().over(order).alias("file_ord"),
        "doc_id",
        "n_pages",
        (F.lit(1) + even(lead) + before).cast("long").alias("start_page"),
    )


def contents_rows(files: DataFrame, page_height: float = 792.0, group: str = "source") -> DataFrame:
    """Rows of the contents page: where each file is listed, given how many lines fit on a page."""
    fit = max(1, int((page_height - 112 - 56) // 20) + 1)
    return merge_starts(files, contents=True, group=group).select(
        group,
        "file_ord",
        "doc_id",
        "start_page",
        (F.floor((F.col("file_ord") - 1) / fit) + 1).cast("int").alias("contents_page"),
        ((F.col("file_ord") - 1) % fit + 1).cast("int").alias("contents_row"),
    )


def nup(docs: DataFrame, per_sheet: int, columns: int, by_column: bool = False) -> DataFrame:
    """(doc_id, page_no, sheet, row, col): pages placed on sheets, by row or by column."""
    rows = per_sheet // columns
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page_no"))
    slot = (F.col("page_no") - 1) % per_sheet
    inner = rows if by_column else columns
    major, minor = F.floor(slot / inner).cast("int"), (slot % inner).cast("int")
    return pages.select(
        "doc_id",
        "page_no",
        (F.floor((F.col("page_no") - 1) / per_sheet) + 1).cast("int").alias("sheet"),
        ((minor if by_column else major) + 1).alias("row"),
        ((major if by_column else minor) + 1).alias("col"),
    )


def booklet(docs: DataFrame) -> DataFrame:
    """(doc_id, sheet, side, slot, page_no): folded sheets; pages beyond the last are blank (null)."""
    n = F.col("n_pages")
    sheets = docs.where(n > 0).select("doc_id", "n_pages", F.explode(F.sequence(F.lit(0), (F.ceil(n / 4) - 1).cast("int"))).alias("s"))
    p, s = (F.ceil(n / 4) * 4).cast("int"), F.col("s")
    places = [("front", 1, p - 2 * s), ("front", 2, 2 * s + 1), ("back", 1, 2 * s + 2), ("back", 2, p - 2 * s - 1)]
    each = F.array(*(F.struct(F.lit(a).alias("side"), F.lit(b).alias("slot"), c.cast("int").alias("page_no")) for a, b, c in places))
    return sheets.select("doc_id", "n_pages", (s + 1).alias("sheet"), F.explode(each).alias("x")).select(
        "doc_id", "sheet", "x.side", "x.slot", F.when(F.col("x.page_no") <= n, F.col("x.page_no")).alias("page_no")
    )


def number_pages(
    docs: DataFrame,
    templates: dict[str, str],
    spec: str = "",
    start: int = 1,
    total: int = 0,
    skip_first: bool = False,
    date: str = "2026-01-01",
    stem: Column | None = None,
    bates: tuple[str, int, int, str] = ("", 1, 6, ""),
) -> DataFrame:
    """(doc_id, page_no, position, label) for templates with {n} {total} {date} {file} {bates}.

    ``bates``: prefix, first number, digits, suffix. A longer number is not cut. The first page may stay
    without a label and still counts. Blank labels are dropped.
    """
    chosen = select_pages(docs, spec, "sorted")
    count = F.count("*").over(Window.partitionBy("doc_id"))
    seq = F.col("ord") - 1
    prefix, first, digits, suffix = bates
    number = (seq + first).cast("string")
    padded = F.lpad(number, F.greatest(F.lit(min(digits, 32)), F.char_length(number)), F.lit("0"))
    values = {
        "{n}": (seq + start).cast("string"),
        "{total}": F.lit(str(total)) if total else F.greatest(count + start - 1, F.lit(0)).cast("string"),
        "{date}": F.lit(date),
        "{file}": stem if stem is not None else F.concat(F.lit("doc"), F.col("doc_id").cast("string")),
        "{bates}": F.concat(F.lit(prefix), padded, F.lit(suffix)),
    }
    labels = []
    for position, template in templates.items():
        text = F.lit(template)
        for token, value in values.items():
            if token in template:
                text = F.replace(text, F.lit(token), value)
        labels.append(F.struct(F.lit(position).alias("position"), text.alias("label")))
    out = chosen.withColumn("labels", F.array(*labels))
    if skip_first:
        out = out.where("ord > 1")
    return out.select("doc_id", "page_no", F.explode("labels").alias("l")).select("doc_id", "page_no", "l.*").where(F.trim("label") != "")
