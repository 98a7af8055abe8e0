"""Affine maps as columns: structs (a, b, c, d, e, f) with x' = a x + c y + e and y' = b x + d y + f."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.geometry import rect


def matrix(a, b, c, d, e, f) -> Column:
    parts = ((x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for x, n in zip((a, b, c, d, e, f), "abcdef", strict=True))
    return F.struct(*parts)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there; a plan doesn't grow with its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def _then(m: Column, n: Column) -> Column:
    e, f = apply(n, m["e"], m["f"])
    columns = [(n["a"] * m[x] + n["c"] * m[y], n["b"] * m[x] + n["d"] * m[y]) for x, y in (("a", "b"), ("c", "d"))]
    return matrix(*columns[0], *columns[1], e, f)


def then(m: Column, n: Column) -> Column:
    """The map that does ``m`` and then ``n``."""
    return let(m, lambda m: let(n, lambda n: _then(m, n)))


def _invert(m: Column) -> Column:
    det = F.nullif(m["a"] * m["d"] - m["b"] * m["c"], F.lit(0.0))
    linear = F.struct((m["d"] / det).alias("a"), (-m["b"] / det).alias("b"), (-m["c"] / det).alias("c"), (m["a"] / det).alias("d"))
    back = let(linear, lambda i: matrix(i["a"], i["b"], i["c"], i["d"], -(i["a"] * m["e"] + i["c"] * m["f"]), -(i["b"] * m["e"] + i["d"] * m["f"])))
    return F.when(det.isNotNull(), back)


def invert(m: Column) -> Column:
    """The map back; null if there is none."""
    return let(m, _invert)


def _map_points(m: Column, points: Column) -> Column:
    def at(v: Column, i: Column) -> Column:
        beside = F.get(points, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        x, y = m["a"] * v + m["c"] * beside + m["e"], m["b"] * beside + m["d"] * v + m["f"]
        return F.when((i % 2 == 0) & beside.isNull(), v).when(i % 2 == 0, x).otherwise(y)

    return F.transform(points, at)


def map_points(m: Column, points: Column) -> Column:
    """A flat list x, y, x, y, ... under a map; a last number without its partner stays."""
    return let(m, lambda m: let(points, lambda p: _map_points(m, p)))


def map_lists(m: Column, strokes: Column) -> Column:
    """Several flat lists, such as the strokes of an ink annotation."""
    return let(m, lambda m: F.transform(strokes, lambda s: _map_points(m, s)))


def _map_box(m: Column, r: Column) -> Column:
    xs, ys = zip(*(apply(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")), strict=True)
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def map_box(m: Column, r: Column) -> Column:
    """The upright box around a mapped rectangle."""
    return let(m, lambda m: let(r, lambda r: _map_box(m, r)))


def upright(box: Column, rotation: Column) -> Column:
    """From a page's own space to what is seen: a clockwise turn by quarters, and the box's least corner at the origin."""
    quarter = F.pmod(F.round(rotation / 90).cast("int"), F.lit(4))
    cos, sin = F.get(F.array(*map(F.lit, (1.0, 0.0, -1.0, 0.0))), quarter), F.get(F.array(*map(F.lit, (0.0, 1.0, 0.0, -1.0))), quarter)
    turned = matrix(cos, -sin, sin, cos, 0.0, 0.0)
    return let(turned, lambda t: let(map_box(t, box), lambda seen: matrix(t["a"], t["b"], t["c"], t["d"], -seen["x0"], -seen["y0"])))


def placed(w: Column, h: Column, to_w: Column, to_h: Column, fit: Column) -> Column:
    """Centred on another paper, scaled to 'fit' in it, to 'fill' it, or to 'stretch' over it."""
    x, y = to_w / w, to_h / h
    same = F.when(fit == "fit", F.least(x, y)).when(fit == "fill", F.greatest(x, y))
    scale = F.struct(F.coalesce(same, x).alias("x"), F.coalesce(same, y).alias("y"))
    return let(scale, lambda s: matrix(s["x"], 0.0, 0.0, s["y"], (to_w - w * s["x"]) / 2, (to_h - h * s["y"]) / 2))


def resized(box: Column, rotation: Column, to_w: Column, to_h: Column, fit: Column, keep_orientation: Column) -> Column:
    """(box, move): the new page box, as stored, and what moves the old page's points there.

    The paper turns with the page if its orientation is kept. The page keeps its rotation, so points go from the old
    space to what is seen, on to the new paper, and back into the page's own space. Null for a page without area.
    """
    flat = F.pmod(F.round(rotation / 90).cast("int"), F.lit(2)) == 0

    def paper(seen: Column) -> Column:
        w, h = seen["x1"] - seen["x0"], seen["y1"] - seen["y0"]
        turn = keep_orientation & ((w > h) != (to_w > to_h))
        return F.struct(w.alias("w"), h.alias("h"), F.when(turn, to_h).otherwise(to_w).alias("tw"), F.when(turn, to_w).otherwise(to_h).alias("th"))

    def moved(up: Column, p: Column) -> Column:
        new = rect(F.lit(0.0), F.lit(0.0), F.when(flat, p["tw"]).otherwise(p["th"]), F.when(flat, p["th"]).otherwise(p["tw"]))
        there = then(up, placed(p["w"], p["h"], p["tw"], p["th"], fit))
        return let(new, lambda new: F.struct(new.alias("box"), then(there, invert(upright(new, rotation))).alias("move")))

    return let(box, lambda box: let(upright(box, rotation), lambda up: let(let(map_box(up, box), paper), lambda p: F.when((p["w"] > 0) & (p["h"] > 0), moved(up, p)))))
