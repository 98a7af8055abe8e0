"""Rectangles, affine maps and paper sizes as native column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM = 72 / 25.4
# Paper sizes, in millimetres and in points.
PAPER_MM = {"a0": (841, 1189), "a1": (594, 841), "a2": (420, 594), "a3": (297, 420), "a4": (210, 297), "a5": (148, 210), "a6": (105, 148), "b4": (250, 353), "b5": (176, 250)}
PAPER_PT = {
    "letter": (612.0, 792.0), "legal": (612.0, 1008.0), "tabloid": (792.0, 1224.0), "ledger": (792.0, 1224.0), "executive": (522.0, 756.0),
    "statement": (396.0, 612.0), "half-letter": (396.0, 612.0),
}
PAPER = {n: (w * MM, h * MM) for n, (w, h) in PAPER_MM.items()} | PAPER_PT
UNIT = {"mm": MM, "cm": 10 * MM, "in": 72.0, "pt": 1.0}
LEAST_SIDE, MOST_SIDE = 10.0, 14_400.0


def rect(x0, y0, x1, y1) -> Column:
    values = (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in (x0, y0, x1, y1))
    return F.struct(*(v.cast("double").alias(n) for v, n in zip(values, ("x0", "y0", "x1", "y1"), strict=True)))


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def grow(r: Column, by: float) -> Column:
    return rect(r["x0"] - by, r["y0"] - by, r["x1"] + by, r["y1"] + by)


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def clamp(r: Column, width, height) -> Column:
    """The part on the page; null if no more than a hundredth of a point is left of a side."""
    out = rect(F.greatest(r["x0"], F.lit(0.0)), F.greatest(r["y0"], F.lit(0.0)), F.least(r["x1"], F.lit(width)), F.least(r["y1"], F.lit(height)))
    return F.when((out["x1"] - out["x0"] > 0.01) & (out["y1"] - out["y0"] > 0.01), out)


def map_rect(r: Column, m: tuple[float, float, float, float, float, float]) -> Column:
    """Bounding box of a rectangle under the affine map x' = ax + cy + e, y' = bx + dy + f."""
    a, b, c, d, e, f = m
    xs = [r[x] * a + r[y] * c + e for x in ("x0", "x1") for y in ("y0", "y1")]
    ys = [r[x] * b + r[y] * d + f for x in ("x0", "x1") for y in ("y0", "y1")]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def to_visible(r: Column, height) -> Column:
    """From the top-left origin of display space to the bottom-left one, or back."""
    return rect(r["x0"], F.lit(height) - r["y1"], r["x1"], F.lit(height) - r["y0"])


def paper(name: Column) -> Column:
    """(width, height) in points of a named size or of WxH with mm, cm, in or pt; null if it is neither."""
    # Arrays of one element bind a value: each step is computed once a row, however often it is used.
    low = F.array(F.lower(F.regexp_replace(name, r"(?U)\s+", "")))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)[x×*]([0-9]+(?:\.[0-9]+)?)(mm|cm|in|pt)?$"
    known = F.create_map(*(x for n, (w, h) in PAPER.items() for x in (F.lit(n), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))))
    units = F.create_map(*(x for u, points in UNIT.items() for x in (F.lit(u), F.lit(points))))

    def given(low: Column) -> Column:
        """Width and height as they are written; null for another text."""
        unit = F.coalesce(F.try_element_at(units, F.regexp_extract(low, pattern, 3)), F.lit(1.0))
        w, h = (F.regexp_extract(low, pattern, i).try_cast("double") * unit for i in (1, 2))
        return F.when(low.rlike(pattern), F.struct(w.alias("w"), h.alias("h")))

    def sized(low: Column) -> Column:
        fits = F.filter(F.array(given(low)), lambda s: s["w"].between(LEAST_SIDE, MOST_SIDE) & s["h"].between(LEAST_SIDE, MOST_SIDE))
        return F.coalesce(F.try_element_at(known, F.when(low == "", "a4").otherwise(low)), F.get(fits, F.lit(0)))

    return F.get(F.transform(low, sized), F.lit(0))


def fit_scale(w: Column, h: Column, to_w: float, to_h: float, mode: str = "fit") -> Column:
    """(x, y) scales that bring a page to a size: 'fit' whole, 'fill' covering, 'stretch' per axis."""
    x, y = F.lit(to_w) / w, F.lit(to_h) / h
    if mode != "stretch":
        x = y = F.least(x, y) if mode == "fit" else F.greatest(x, y)
    return F.struct(x.alias("x"), y.alias("y"))
