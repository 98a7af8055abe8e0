"""Default appearances of form fields, and sizes that make their text fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import glyphs

#: Operators that set a fill colour, with the number of their operands.
COLOURS = {"g": 1, "rg": 3, "k": 4}
MOST_SIZE = 144.0
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_appearance(appearance: Column) -> Column:
    """(size, colour) of a default appearance such as ``/Helv 11 Tf 0 g``.

    A fold over the tokens that keeps the run of numbers before each operator: the last size and the last colour with
    enough operands win. No size, a wrong one, or one that is not positive is 0 (fit the text); sizes end at
    MOST_SIZE. Without a colour it is black. A null appearance is an empty one.
    """
    tokens = F.filter(F.split(F.coalesce(appearance, F.lit("")), r"\s+"), lambda t: t != "")
    none = F.array().cast("array<string>")
    state = F.struct(F.lit(0.0).alias("size"), F.lit("0 g").alias("colour"), none.alias("numbers"))

    def step(s: Column, t: Column) -> Column:
        held = F.size(s["numbers"])
        size = F.when(t == "Tf", F.coalesce(F.get(s["numbers"], held - 1).cast("double"), F.lit(0.0))).otherwise(s["size"])
        need = F.coalesce(*(F.when(t == op, n) for op, n in COLOURS.items()))
        colour = F.when(held >= need, F.concat(F.array_join(F.slice(s["numbers"], F.greatest(held - need + 1, F.lit(1)), need), " "), F.lit(" "), t)).otherwise(s["colour"])
        # Four operands are the most that count.
        numbers = F.when(t.rlike(NUMBER), F.concat(F.slice(s["numbers"], F.greatest(held - 2, F.lit(1)), 3), F.array(t))).otherwise(none)
        return F.struct(size.alias("size"), F.coalesce(colour, s["colour"]).alias("colour"), numbers.alias("numbers"))

    def finish(s: Column) -> Column:
        return F.struct(F.when(s["size"] > 0, F.least(s["size"], F.lit(MOST_SIZE))).otherwise(0.0).alias("size"), s["colour"].alias("colour"))

    return F.aggregate(tokens, state, step, finish)


def line_size(text: Column, given: Column, width: Column, height: Column, border: Column | float = 1.0) -> Column:
    """Font size of a field's one line in a box: the ``given`` one, else the largest that fits, from 4 to 12 points."""
    line = F.regexp_replace(text, r"[\r\n]", " ")
    by_height = F.least(F.greatest(height - 4, F.lit(4.0)), F.lit(12.0))
    wide = glyphs.text_units(line)
    fits = F.greatest(F.least(by_height, inner(width, height, width, border) * 1000 / F.nullif(wide, F.lit(0))), F.lit(4.0))
    return F.when(given > 0, given).otherwise(F.coalesce(fits, by_height))


def inner(width: Column, height: Column, side: Column, border: Column | float = 1.0) -> Column:
    """What a field's border and padding leave of one side: the padding is two points at least, a quarter of a side at most."""
    border = F.lit(border) if not isinstance(border, Column) else border
    pad = F.least(F.greatest(border + 1, F.lit(2.0)), width / 4, height / 4)
    return F.greatest(side - 2 * pad, F.lit(1.0))


def block_size(n_lines: Column, given: Column, width: Column, height: Column, border: Column | float = 1.0, leading: float = 1.15) -> Column:
    """Font size at which ``n_lines`` lines fit a box: the ``given`` one, else the largest half point from 4 to 12.

    A closed form: the greatest number of half points with lines * size * leading within the inner height.
    """
    room = inner(width, height, height, border)
    half_points = F.floor(room / (F.greatest(n_lines, F.lit(1)) * leading) * 2) / 2
    return F.when(given > 0, given).otherwise(F.greatest(F.least(half_points, F.lit(12.0)), F.lit(4.0)))
