"""Widths of text by glyph widths, and what fits a width, as folds in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Helvetica's glyph widths for the codes 32 to 126, in thousandths of the font size.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
#: Width of a character that the table lacks.
OTHER = 556
ELLIPSIS = "…"


def chars(text: Column) -> Column:
    """The characters of a text, one by one; none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def units(c: Column, widths: list[int] = HELVETICA, first: int = 32, other: int = OTHER) -> Column:
    """Width of one character in thousandths of the size."""
    code = F.ascii(c) - first
    return F.when((code >= 0) & (code < len(widths)), F.get(F.lit(widths), code)).otherwise(other)


def text_units(text: Column, widths: list[int] = HELVETICA) -> Column:
    """Width of a text in thousandths of the size, a whole number."""
    return F.aggregate(chars(text), F.lit(0).cast("long"), lambda n, c: n + units(c, widths))


def text_width(text: Column, size: Column | float, widths: list[int] = HELVETICA) -> Column:
    return text_units(text, widths) * size / 1000


def longest_prefix(text: Column, room: Column, widths: list[int] = HELVETICA) -> Column:
    """Number of characters whose widths, from the first on, add up to at most ``room`` units: one pass, no prefix is built."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"))

    def step(s: Column, c: Column) -> Column:
        fits = s["open"] & (s["used"] + units(c, widths) <= room)
        return F.struct((s["n"] + fits.cast("long")).alias("n"), (s["used"] + units(c, widths)).alias("used"), fits.alias("open"))

    return F.aggregate(chars(text), state, step, lambda s: s["n"])


def fit_line(text: Column, size: Column | float, most: Column | float, widths: list[int] = HELVETICA) -> Column:
    """``text`` if it is at most ``most`` wide, else its longest beginning that fits with an ellipsis; '' if none does.

    White space before the ellipsis goes. Widths are compared as whole units, so no sum is rounded.
    """
    most = F.lit(most) if not isinstance(most, Column) else most
    room = F.floor(most * 1000 / size).cast("long")
    n = longest_prefix(text, room - text_units(F.lit(ELLIPSIS), widths), widths)
    cut = F.concat(F.regexp_replace(F.left(text, n.cast("int")), r"\s+$", ""), F.lit(ELLIPSIS))
    return F.when(text_units(text, widths) <= room, text).when(n == 0, "").otherwise(cut)
