"""From glyphs to words, lines and paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values, in parts of the font size.
BASELINE, BACKSTEP, WORD_GAP = 0.5, 2.0, 0.25
SAME_ROW, HEADING = 0.4, 1.25
LINES = "page string, line_no int, word_no int, text string, x0 double, x1 double, y double, size double"


def group_glyphs(glyphs: DataFrame) -> DataFrame:
    """Words (page, line_no, word_no, text, x0, x1, y, size) of glyphs (page, ord, ch, x0, x1, y, size, angle).

    A line keeps the baseline of its first glyph, so this is a fold per page and not a lag.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        line, word, base, largest, last, angle, fresh = 0, 0, 0.0, 0.0, 0.0, None, True
        for g in page.sort_values("ord").itertuples():
            new_line = angle is None or g.angle != angle or abs(g.y - base) >= BASELINE * max(largest, g.size) or g.x0 <= last - BACKSTEP * largest
            if new_line:
                line, word, base, largest, angle, fresh = line + 1, 0, g.y, g.size, g.angle, True
            largest = max(largest, g.size)
            if g.ch.isspace():
                fresh = True
            else:
                if fresh or (not new_line and g.x0 - last > WORD_GAP * g.size):
                    word += 1
                    out.append([g.page, line, word, "", g.x0, g.x1, base, g.size])
                out[-1][3] += g.ch
                out[-1][5] = g.x1
                fresh = False
            last = g.x1
        return pd.DataFrame(out, columns=["page", "line_no", "word_no", "text", "x0", "x1", "y", "size"])

    return glyphs.groupBy("page").applyInPandas(fold, LINES)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(page, line_no, text, joins, heading) of lines (page, line_no, text, y, size).

    ``joins``: on one row with the line before (a tab in the paragraph); ``heading``: clearly larger than the
    page's upper median size.
    """
    order = Window.partitionBy("page").orderBy("line_no")
    sizes = lines.groupBy("page").agg(F.array_sort(F.collect_list("size")).alias("s"))
    median = sizes.select("page", F.get("s", (F.size("s") / 2).cast("int")).alias("median"))
    before = F.lag("y").over(order)
    return (
        lines.withColumn("joins", F.coalesce(F.abs(F.col("y") - before) < SAME_ROW * F.col("size"), F.lit(False)))
        .join(median, "page")
        .select("page", "line_no", "text", "joins", (F.col("size") > HEADING * F.col("median")).alias("heading"))
    )


def reading_order(words: DataFrame) -> DataFrame:
    """``words`` (page, x0, y0, y1, ..) with row and place: the row on the page from the top, and the place in reading order.

    Words in the order of their centres start a new row where the centre lies more than SAME_ROW of the
    larger height below the one before; a row reads from left to right. Ties go by x0, then by text, then by
    y0, so that heights of words with one centre come in one order. Pages are windows of their own; words
    without a position come first on their page.
    """
    down = Window.partitionBy("page").orderBy("_mid", "x0", "text")
    each = Window.partitionBy("page").orderBy("_mid", "x0", "text", "y0")
    far = F.col("_mid") - F.lag("_mid").over(each) > SAME_ROW * F.greatest("_size", F.lag("_size").over(each))
    sized = words.withColumn("_mid", (F.col("y0") + F.col("y1")) / 2).withColumn("_size", F.col("y1") - F.col("y0"))
    rows = sized.withColumn("_new", far.cast("int")).withColumn("row", (F.coalesce(F.sum("_new").over(down), F.lit(0)) + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("row", "x0", "_mid", "text", "y0"))
    return rows.withColumn("place", place).drop("_mid", "_size", "_new")


def place_marks(lines: DataFrame, labels: Column, per_page: int, pitch: float = 14.0, advance: float = 5.0) -> DataFrame:
    """Marks with rectangles, numbered down each document: (doc_id, mark_no, page_no, label, x0, y0, x1, y1).

    ``labels`` are the texts found on a line, in its order; each is looked for after the end of the one before.
    Lines stand ``pitch`` apart, letters ``advance`` wide. Marks go by page, then from the top, then from the left.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,label:string>>").alias("out"))

    def step(done: Column, label: Column) -> Column:
        at = F.position(label, F.col("text"), done["at"])
        return F.struct((at + F.char_length(label)).alias("at"), F.concat(done["out"], F.array(F.struct(at.alias("at"), label.alias("label")))).alias("out"))

    each = lines.select("doc_id", "page_no", "line_no", F.explode(F.aggregate(labels, start, step, lambda done: done["out"])).alias("m"))
    x0, y0 = (F.col("m.at") - 1) * advance, ((F.col("line_no") - 1) % per_page) * pitch
    placed = each.select(
        "doc_id", "page_no", F.col("m.label").alias("label"), x0.alias("x0"), y0.alias("y0"), (x0 + F.char_length("m.label") * advance).alias("x1"), (y0 + pitch).alias("y1")
    )
    return placed.withColumn("mark_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "y0", "x0")))
