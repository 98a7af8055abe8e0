"""Form fields, annotations and bookmarks: lookups, upserts, overlaps, tree walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.blocks import free_number, number_in_order

from quire.functions.geometry import intersects
from quire.plans import scratch
from quire.plans.joins import join_small

# Fixed values.
TRUTHY = ("true", "yes", "on", "1", "checked", "x")
HIDDEN_BITS = (1 << 1) | (1 << 5)
#: Pairs of one part of a cell, and parts of the join, of ``overlaps``.
PAIRS, MOST_TASKS = 4_000_000, 5000


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin(*TRUTHY)


def visible(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(HIDDEN_BITS)) == 0


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Fields (doc_id, name, kind, value) with new values (doc_id, name, value) where given, and what happened.

    Check boxes take truthy text. A value without a field comes back with outcome 'unknown'.
    """
    both = fields.alias("f").join(values.alias("v"), ["doc_id", "name"], "full")
    new = F.when(F.col("f.kind") == "checkbox", F.when(truthy(F.col("v.value")), "On").otherwise("Off")).otherwise(F.col("v.value"))
    return both.select(
        "doc_id",
        "name",
        F.col("f.kind").alias("kind"),
        F.when(F.col("v.value").isNull(), F.col("f.value")).otherwise(new).alias("value"),
        F.when(F.col("f.kind").isNull(), "unknown").when(F.col("v.value").isNull(), "kept").otherwise("filled").alias("outcome"),
    )


def choose(values: DataFrame, options: DataFrame) -> DataFrame:
    """(field, value, export): the option a value names by export or display text, the first such option.

    An OR join becomes one equi-join on the two texts an option answers to.
    """
    names = options.select("field", "idx", "export", F.explode(F.array_distinct(F.array("export", "display"))).alias("value"))
    best = names.groupBy("field", "value").agg(F.min_by("export", "idx").alias("export"))
    return values.join(best, ["field", "value"], "left")


def overlaps(a: DataFrame, b: DataFrame, cell: float | None = None) -> DataFrame:
    """(page, a_id, b_id) of rectangles (page, id, r) that overlap.

    A theta join on grid cells: each rectangle goes to the cells it touches, pairs meet by page and cell and are
    counted in the cell of their common corner only, so nothing is compared across the whole page and no pair
    comes twice. Cells are twice as wide and high as the root mean square of the rectangles (or ``cell``), so that all
    of them touch a few cells on average. A crowded cell is cut in parts of about PAIRS pairs, and the parts are dealt
    to as many tasks as the pairs ask for.
    """
    if cell is None:
        sides = [F.sqrt(F.avg(F.pow(F.col(f"r.{hi}") - F.col(f"r.{lo}"), 2))) for lo, hi in (("x0", "x1"), ("y0", "y1"))]
        about = a.select("r").union(b.select("r")).agg(*(s.alias(n) for s, n in zip(sides, "wh", strict=True))).first()
        wide, high = (2 * about[n] if about[n] and 0 < about[n] < float("inf") else 100.0 for n in "wh")
    else:
        wide = high = cell

    def cells(df: DataFrame, side: str) -> DataFrame:
        r = F.col("r")
        xs = F.sequence(F.floor(r["x0"] / wide), F.floor(r["x1"] / wide))
        ys = F.sequence(F.floor(r["y0"] / high), F.floor(r["y1"] / high))
        return df.select("page", F.col("id").alias(f"{side}_id"), r.alias(f"r_{side}"), F.explode(xs).alias("cx"), ys.alias("ys")).select(
            "page", f"{side}_id", f"r_{side}", "cx", F.explode("ys").alias("cy")
        )

    at = ["page", "cx", "cy"]
    left, right = cells(a, "a"), cells(b, "b")
    counts = left.groupBy(*at).agg(F.count("*").alias("n_a")).join(right.groupBy(*at).agg(F.count("*").alias("n_b")), at)
    counts = scratch.write(counts.withColumn("parts", F.ceil(F.col("n_a") * F.col("n_b") / PAIRS)), "cells")
    sums = counts.agg(F.count("*").alias("n"), F.sum(F.col("n_a") * F.col("n_b")).alias("pairs")).first()
    tasks = max(1, min(MOST_TASKS, -(-(sums["pairs"] or 0) // PAIRS)))
    parts = counts.select(*at, "parts")
    left = join_small(left, parts, at, "inner", sums["n"], 80).withColumn("part", F.pmod(F.xxhash64("a_id"), "parts")).drop("parts")
    right = join_small(right, parts, at, "inner", sums["n"], 80).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    where = [*at, "part"]
    pairs = left.repartition(tasks, *where).join(right.repartition(tasks, *where).hint("shuffle_merge"), where)
    ra, rb = F.col("r_a"), F.col("r_b")
    home = (F.floor(F.greatest(ra["x0"], rb["x0"]) / wide) == F.col("cx")) & (F.floor(F.greatest(ra["y0"], rb["y0"]) / high) == F.col("cy"))
    return pairs.where(intersects(ra, rb) & home).select("page", "a_id", "b_id")


def walk(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """(node, depth, path, value) from rows (node, parent, label, value): dotted names, values inherited.

    Rows with a null parent are roots. One join per level with the last level only; orphans and cycles are never
    reached and so not listed. A tree deeper than ``most_depth`` raises.
    """
    level = nodes.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("label").alias("path"), "value")
    level = scratch.write(level, "walk")
    out = level
    for depth in range(1, most_depth + 2):  # the last round finds nothing
        up = level.select(F.col("node").alias("parent"), F.col("path").alias("p"), F.col("value").alias("v"))
        nxt = nodes.join(up, "parent").select(
            "node", F.lit(depth).alias("depth"), F.concat_ws(".", "p", "label").alias("path"), F.coalesce("value", "v").alias("value")
        )
        level = scratch.write(nxt, "walk")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"the tree is deeper than {most_depth}")


def keep_with_descendants(nodes: DataFrame, alive: DataFrame) -> DataFrame:
    """(node) kept of a tree (node, parent): alive nodes and all their ancestors."""
    edges = nodes.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    from quire.operators.graph import reachable

    return reachable(edges, alive.select("node")).select("node").distinct()


def siblings(nodes: DataFrame) -> DataFrame:
    """(node, prev, next, count): neighbours below one parent in order, and the number of children."""
    w = Window.partitionBy("parent").orderBy("ord")
    linked = nodes.select("node", F.lag("node").over(w).alias("prev"), F.lead("node").over(w).alias("next"))
    counts = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    return linked.join(counts, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def rename_clashes(fields: DataFrame) -> DataFrame:
    """(file_ord, name, new_name): a name that an earlier file has too gets _2, _3, ... .

    Numbers that would give a name of the input are left out, so new names are unique.
    """
    numbered = number_in_order(fields.select("file_ord", "name"), ["name"], "file_ord", "k")
    form = r"^(.*)_([1-9][0-9]{0,8})$"
    base, n = F.regexp_extract("name", form, 1), F.regexp_extract("name", form, 2)
    names = fields.select("name").distinct().where(F.col("name").rlike(form)).select(base.alias("base"), n.cast("long").alias("n"))
    taken = names.where("n > 1").groupBy("base").agg(F.sort_array(F.collect_list("n")).alias("taken"))
    joined = numbered.join(taken, F.col("name") == F.col("base"), "left")
    fresh = F.concat_ws("_", "name", free_number(F.col("k"), F.col("taken")).cast("string"))
    return joined.select("file_ord", "name", F.when(F.col("k") == 1, F.col("name")).otherwise(fresh).alias("new_name"))


def display_values(fields: DataFrame, options: DataFrame) -> DataFrame:
    """``fields`` (field, kind, value as an array of texts) with shown: for a choice the display text of its option.

    The values that are not empty are joined by comma and blank. Of options (field, idx, export, display) with
    one export text the first counts; a value without an option is shown as it is.
    """
    joined = F.array_join(F.filter("value", lambda v: v != ""), ", ")
    first = options.groupBy("field", F.col("export").alias("_text")).agg(F.min_by("display", "idx").alias("_shown"))
    found = fields.withColumn("_text", joined).join(first, ["field", "_text"], "left")
    shown = F.when(F.col("kind") == "choice", F.coalesce("_shown", "_text")).otherwise(F.col("_text"))
    return found.select(*fields.columns, F.coalesce(shown, F.lit("")).alias("shown"))
