"""Annotations, references, outlines and numbers of document objects, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import graph
from quire.operators import trees


def fates(annots: DataFrame) -> DataFrame:
    """(id, fate) of annotations (id, subtype, parent, invisible, drawable): drop, draw or keep.

    A pop-up is kept only while the annotation that it belongs to is kept, and dropped else.
    """
    own = F.when(F.col("invisible"), "drop").when(F.col("drawable"), "draw").otherwise("keep")
    judged = annots.select("id", "parent", F.when(F.col("subtype") != "Popup", own).alias("own"))
    stays = judged.where("own = 'keep'").select(F.col("id").alias("owner"), F.lit("keep").alias("of_owner"))
    joined = judged.join(stays, (F.col("parent") == F.col("owner")) & F.col("own").isNull(), "left")
    return joined.select("id", F.coalesce("own", "of_owner", F.lit("drop")).alias("fate"))


def annotation_summary(annots: DataFrame, key: str) -> DataFrame:
    """(key, links, annotations): widgets and pop-ups count as neither."""
    link, other = F.col("subtype") == "Link", ~F.col("subtype").isin("Link", "Widget", "Popup")
    return annots.groupBy(key).agg(F.count_if(link).alias("links"), F.count_if(other).alias("annotations"))


def visible_counts(nodes: DataFrame) -> DataFrame:
    """(node, n_visible) of outline items (node, parent, open) with children: items shown below it, negative if closed.

    An item shows below another if all between them are open. Any depth takes the rounds of ``trees.subtree_sums``.
    """
    sums = trees.subtree_sums(nodes, F.lit(1), F.col("open")).withColumnRenamed("node", "n")
    parents = nodes.select(F.col("parent").alias("p")).distinct()
    shown = nodes.join(parents, F.col("node") == F.col("p"), "left_semi").join(sums, F.col("node") == F.col("n"))
    return shown.select("node", F.when(F.col("open"), F.col("total")).otherwise(-F.col("total")).alias("n_visible"))


def bookmark_states(bookmarks: DataFrame, first: DataFrame, second: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page, state): names of bookmarks (id, name) resolved by two tables (name, page); the second wins.

    live: the page is there; dead: it is not; unknown: no table has the name.
    """
    named = first.select("name", "page", F.lit(1).alias("rank")).union(second.select("name", "page", F.lit(2)))
    known = named.groupBy("name").agg(F.max_by("page", F.struct("rank", "page")).alias("page"))
    there = pages.select("page").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("page").isNull(), "unknown").when(F.col("there"), "live").otherwise("dead")
    return bookmarks.join(known, "name", "left").join(there, "page", "left").select("id", "page", state.alias("state"))


def gaps(objects: DataFrame, key: str, number: str) -> DataFrame:
    """(key, number) that are missing from 1 to the key's largest number."""
    used = objects.select(key, number).distinct()
    before = F.coalesce(F.lag(number).over(Window.partitionBy(key).orderBy(number)), F.lit(0))
    holes = used.withColumn("_from", before + 1).where(F.col("_from") < F.col(number))
    return holes.select(key, F.explode(F.sequence(F.col("_from"), F.col(number) - 1)).alias(number))


def image_use(images: DataFrame, uses: DataFrame) -> DataFrame:
    """(image, width, height, first_page, used): largest drawn size of each image; unused ones have none."""
    drawn = uses.groupBy("image").agg(F.max("w").alias("width"), F.max("h").alias("height"), F.min("page").alias("first_page"))
    return images.select("image").join(drawn, "image", "left").withColumn("used", F.col("first_page").isNotNull())


def tree_outcome(edges: DataFrame, present: DataFrame, roots: DataFrame) -> DataFrame:
    """One row kept, lost, orphans of a tree: reached and present; referred to from there and absent; present and never reached."""
    reached = graph.reachable(edges.join(present.select(F.col("node").alias("src")), "src", "left_semi"), roots).select("node").distinct()
    both = present.select("node", F.lit(True).alias("here")).join(reached.withColumn("seen", F.lit(True)), "node", "full")
    return both.agg(F.count_if(F.col("here") & F.col("seen")).alias("kept"), F.count_if(F.col("here").isNull()).alias("lost"), F.count_if(F.col("seen").isNull()).alias("orphans"))


def recent(uses: DataFrame, key: str, item: str, order: list[str], most: int = 5) -> DataFrame:
    """(key, rank, item): a key's items by latest use, each once, at most ``most``."""
    latest = uses.groupBy(key, item).agg(F.max(F.struct(*order)).alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").desc()))
    return latest.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", item)


def column_widths(cells: DataFrame, key: str, avail: float, letter: float = 5.0, pad: float = 4.0, measure: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, col, width): columns of cells (key, col, text) that share ``avail``.

    ``measure`` gives a text's width (None: ``letter`` for each character); ``letter`` is also the unit of the least width.

    A column would like its longest text and needs its longest word, at least four letters and at most a third. If
    not all wishes fit, the rest goes by what each wishes beyond its need; if the needs don't fit, they shrink alike.
    """
    measure = measure or (lambda t: F.char_length(t) * letter)
    words = F.transform(F.split("text", r"\s+"), measure)
    by = cells.groupBy(key, "col").agg(F.max(measure(F.col("text"))).alias("line"), F.max(F.array_max(words)).alias("word"))
    wish, floor = F.col("line") + 2 * pad, F.lit(4 * letter)
    need = F.least(F.greatest(F.least("word", F.lit(avail / 3)), floor) + 2 * pad, F.greatest(wish, floor + 2 * pad))
    each = by.select(key, "col", wish.alias("wish"), need.alias("need")).withColumn("extra", F.greatest(F.col("wish") - F.col("need"), F.lit(0.0)))
    whole = Window.partitionBy(key)
    needed, extra = F.sum("need").over(whole), F.sum("extra").over(whole)
    given = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (avail - needed) / F.nullif(extra, F.lit(0.0)))), F.lit(0.0))
    return each.select(key, "col", ((F.col("need") + given * F.col("extra")) * F.least(F.lit(1.0), avail / needed)).alias("width"))


def best_layout(sizes: DataFrame, layouts: list[tuple[int, float, float]]) -> DataFrame:
    """(layout, coverage): the layout (number, cell width, cell height) whose fitted pages (w, h) cover most paper."""

    def covered(cell_w: float, cell_h: float) -> Column:
        scale = F.least(cell_w / F.greatest("w", F.lit(1.0)), cell_h / F.greatest("h", F.lit(1.0)))
        return F.sum(scale * scale * F.col("w") * F.col("h"))

    one = sizes.agg(*(covered(w, h).alias(str(n)) for n, w, h in layouts))
    pairs = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("layout"), F.col(str(n)).alias("coverage")) for n, _, _ in layouts))).alias("x"))
    return pairs.select("x.*").orderBy(F.desc("coverage"), "layout").limit(1)


#: Fixed values of a tiling: steps along and across in parts of the stamp and of the page, and the least step.
ALONG, ACROSS, LEAST_STEP = (1.3, 0.04), (2.2, 0.07), 12.0


def _crossed(slope: Column, offset: Column, half: Column) -> tuple[Column, Column]:
    """The open interval of u in which |slope * u + offset| < half; without a slope all u, or none."""
    a, b = (-half - offset) / F.nullif(slope, F.lit(0.0)), (half - offset) / F.nullif(slope, F.lit(0.0))
    never = (slope == 0) & (F.abs(offset) >= half)
    low = F.when(never, F.lit(1.0)).otherwise(F.coalesce(F.least(a, b), F.lit(float("-inf"))))
    return low, F.when(never, F.lit(0.0)).otherwise(F.coalesce(F.greatest(a, b), F.lit(float("inf"))))


def tile_centres(pages: DataFrame, angle: float) -> DataFrame:
    """(page, row_no, col_no, x, y) of a stamp (bw, bh) tiled over pages (page, w, h, bw, bh).

    The grid lies along the rotated axes, odd rows are moved by half a step; stamps that touch the page stay. A stamp
    touches if its centre is in the page grown by the stamp's upright half sizes. The corners of that box in the rotated
    frame bound the rows; in a row its sides cut out one stretch of the axis, and just its columns are made.
    """
    a = F.radians(F.lit(angle))
    cos, sin = F.cos(a), F.sin(a)
    box = pages.select(
        "*",
        ((F.col("w") + F.col("bw") * F.abs(cos) + F.col("bh") * F.abs(sin)) / 2).alias("half_x"),
        ((F.col("h") + F.col("bw") * F.abs(sin) + F.col("bh") * F.abs(cos)) / 2).alias("half_y"),
        F.greatest(ALONG[0] * F.col("bw") + ALONG[1] * F.col("w"), F.lit(LEAST_STEP)).alias("along"),
        F.greatest(ACROSS[0] * F.col("bh") + ACROSS[1] * F.col("h"), F.lit(LEAST_STEP)).alias("across"),
    )
    corner = F.floor((F.col("half_x") * F.abs(sin) + F.col("half_y") * F.abs(cos)) / F.col("across")).cast("int")
    rows = box.withColumn("row_no", F.explode(F.sequence(-corner, corner)))
    v = F.col("row_no") * F.col("across")
    by_x, by_y = _crossed(cos, -v * sin, F.col("half_x")), _crossed(sin, v * cos, F.col("half_y"))
    moved = F.when(F.pmod("row_no", F.lit(2)) == 1, 0.5).otherwise(0.0)
    first = F.floor(F.greatest(by_x[0], by_y[0]) / F.col("along") - moved).cast("int") + 1
    last = F.ceil(F.least(by_x[1], by_y[1]) / F.col("along") - moved).cast("int") - 1
    cells = rows.withColumn("last", last).withColumn("first", first).where("first <= last").withColumn("col_no", F.explode(F.sequence("first", "last")))
    u = (F.col("col_no") + moved) * F.col("along")
    return cells.select("page", "row_no", "col_no", (F.col("w") / 2 + u * cos - v * sin).alias("x"), (F.col("h") / 2 + u * sin + v * cos).alias("y"))


def without_redacted(fields: DataFrame, marks: DataFrame) -> DataFrame:
    """Fields (doc_id, page_no, ...) of pages that no mark is on."""
    return fields.join(marks.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")


#: What each kind of finding is called in a summary.
REASONS = (("font", "fonts that the file lacks"), ("colour", "colours outside any profile"), ("annotation", "annotations without a look of their own"))


def rule_report(rows: DataFrame, key: str) -> DataFrame:
    """What keeps each file from the archive rules, by reason: (key, fonts, cmyk, bare_annotations, keepable, summary).

    ``rows`` has kind (font, colour or annotation), name, and ok: the font is embedded, the colour is not
    CMYK, the annotation has an appearance. One aggregation; names come sorted and once. The summary lists each
    reason with its names, or else its number.
    """
    bad = ~F.coalesce("ok", F.lit(False))
    counts = rows.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(bad & (F.col("kind") == "font"), F.col("name")))), ", ").alias("fonts"),
        *(F.count_if(bad & (F.col("kind") == kind)).alias(f"n_{kind}") for kind, _ in REASONS),
    )
    # A font without a name is not listed, so it keeps nothing back.
    counts = counts.withColumn("n_font", F.when(F.col("fonts") == "", 0).otherwise(F.col("n_font")))
    found = F.array(*(F.struct(F.lit(said).alias("said"), F.col(f"n_{kind}").alias("n"), (F.col("fonts") if kind == "font" else F.col(f"n_{kind}").cast("string")).alias("what")) for kind, said in REASONS))
    found = F.filter(found, lambda x: x["n"] > 0)
    return counts.select(
        key,
        "fonts",
        (F.col("n_colour") > 0).alias("cmyk"),
        F.col("n_annotation").alias("bare_annotations"),
        (F.size(found) == 0).alias("keepable"),
        F.array_join(F.transform(found, lambda x: F.concat(x["said"], F.lit(": "), x["what"])), "; ").alias("summary"),
    )
