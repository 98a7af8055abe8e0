"""Affine maps, form fields and text layers on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry, glyphs, matrix
from quire.operators import forms


def test_maps_compose_and_invert(spark):
    random.seed(12)
    rows = [tuple(random.uniform(-3, 3) for _ in range(14)) for _ in range(50)]
    frame = spark.createDataFrame(rows, ", ".join(f"v{i} double" for i in range(14)))
    m, n = matrix.matrix(*(F.col(f"v{i}") for i in range(6))), matrix.matrix(*(F.col(f"v{i}") for i in range(6, 12)))
    points = F.array("v12", "v13", "v0")
    once = matrix.map_points(matrix.then(m, n), points)
    twice = matrix.map_points(n, matrix.map_points(m, points))
    back = matrix.map_lists(matrix.invert(m), F.array(matrix.map_points(m, points)))
    for r, (a, b, c) in zip(rows, frame.select(once, twice, back).collect(), strict=True):
        assert a == pytest.approx(b) and c[0] == pytest.approx([r[12], r[13], r[0]], abs=1e-6)
    flat = spark.range(1).select(matrix.invert(matrix.matrix(1, 2, 2, 4, 0, 0)), matrix.map_points(matrix.matrix(1, 0, 0, 1, 5, 5), F.array().cast("array<double>"))).first()
    assert tuple(flat) == (None, [])


@pytest.mark.parametrize("rotation", [0, 90, 180, 270, -90, 450])
@pytest.mark.parametrize("fit", ["fit", "fill", "stretch"])
def test_resized_pages_keep_what_is_seen(spark, rotation, fit):
    """The page's seen corners go to the paper's: centred, and on its edges where the fit says so."""
    box = geometry.rect(F.lit(10.0), F.lit(20.0), F.lit(210.0), F.lit(320.0))
    new = matrix.resized(box, F.lit(rotation), F.lit(600.0), F.lit(400.0), F.lit(fit), F.lit(True))
    r = spark.range(1).select(new.alias("n")).select("n.box", matrix.map_box(F.col("n.move"), box).alias("at")).first()
    w, h = (600, 400) if rotation % 180 else (400, 600)  # as seen, the paper lies like the page
    stored = (w, h) if rotation % 180 == 0 else (h, w)
    assert (r["box"]["x0"], r["box"]["y0"], r["box"]["x1"], r["box"]["y1"]) == (0, 0, *stored)
    at = r["at"]
    assert at["x0"] + at["x1"] == pytest.approx(stored[0]) and at["y0"] + at["y1"] == pytest.approx(stored[1])
    sides = sorted((at["x1"] - at["x0"], at["y1"] - at["y0"]))
    assert sides == pytest.approx({"fit": [400, 600], "fill": [400, 600], "stretch": [400, 600]}[fit])
    none = matrix.resized(geometry.rect(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(9.0)), F.lit(0), F.lit(9.0), F.lit(9.0), F.lit("fit"), F.lit(False))
    assert spark.range(1).select(none).first()[0] is None


def test_places_get_free_names(spark):
    fields = spark.createDataFrame([("a", "text", 5), ("a 2", "text", 1), ("a 4", "text", 1), ("one", "choice", 1), ("b", "button", 2), ("x.y", "choice", 3)], "field string, kind string, n_places int")
    asked = [(1, "a", 2, "p"), (2, "a", 3, "q"), (3, "a", 1, None), (4, "a", 3, "r"), (5, "one", 1, "s"), (6, "b", 1, "t"), (7, "none", 1, "u"), (8, "a", 9, "v"), (9, "x.y", 2, "w")]
    got = {(r["field"], r["value"]): (r["name"], r["problem"]) for r in forms.detach_places(fields, spark.createDataFrame(asked, "ord int, field string, place int, value string")).collect()}
    assert got == {
        ("a", "p"): ("a 3", None), ("a", "q"): ("a 5", None), ("a", None): ("a 1", None), ("a", "r"): ("a 6", None), ("one", "s"): ("one", None),
        ("b", "t"): (None, "cannot be filled by place"), ("none", "u"): (None, "no such field"), ("a", "v"): (None, "no such place"), ("x.y", "w"): ("x.y 2", None),
    }


def test_fields_settle_on_held_pages(spark):
    rows = [("r", None, False), ("k", "r", False), ("w1", "k", True), ("w2", "r", True), ("lone", None, None), ("alone", None, True), ("gone", None, False), ("w3", "gone", True)]
    frame = spark.createDataFrame(rows, "node string, parent string, widget boolean")
    held = spark.createDataFrame([("w1",), ("w1",), ("other",)], "node string")
    assert {r["node"] for r in forms.settle_fields(frame, held).collect()} == {"r", "k", "w1", "lone"}
    signed = [("r", None, True, True), ("k", "r", None, True), ("s", "k", True, True), ("t", None, True, None)]
    counts = forms.signed_counts(spark.createDataFrame(signed, "node string, parent string, signature boolean, has_value boolean"))
    assert {r["node"]: r["signed"] for r in counts.collect()} == {"r": 2, "t": 0}


def test_annotations_fall_back_on_their_own_page(spark):
    listed = spark.createDataFrame([("p2", 1), ("p1", 1), ("gone", 2)], "page string, id long")
    own = spark.createDataFrame([(1, "p3"), (2, "p3"), (3, "gone"), (4, None)], "id long, page string")
    pages = spark.createDataFrame([("p1", 1), ("p2", 2), ("p3", 3)], "page string, page_no int")
    assert {r["id"]: r["page_no"] for r in forms.annotation_pages(listed, own, pages).collect()} == {1: 1, 2: 3, 3: None, 4: None}


def test_runs_of_a_text_layer(spark):
    rows = [(1, 1, 7, "Tap", 0.0, 10.0, 30.0, 9.3), (1, 2, 7, " ", 40.0, 10.0, 1.0, 500.0), (1, 3, 7, "one", 50.0, 12.0, 20.0, 5.2), (1, 4, 3, "Z", 0.0, 30.0, 9.0, 7.2), (1, 5, 7, "é", 0.0, 40.0, 0.0, 7.2)]
    words = spark.createDataFrame(rows, "page int, seq int, line int, text string, x double, y double, w double, h double")
    got = {r["seq"]: r for r in forms.text_layer(words, 2.0, 100.0).collect()}
    assert sorted(got) == [1, 3, 4, 5] and [got[k]["run"] for k in sorted(got)] == [1, 1, 2, 3]
    assert [got[k]["shown"] for k in sorted(got)] == ["Tap ", "one", "Z", "é"]
    assert got[1]["size"] == pytest.approx(10 / 2) and got[1]["y"] == got[3]["y"] == pytest.approx(100 - 17.2 / 2)
    width = sum(glyphs.HELVETICA[ord(c) - 32] for c in "Tap") * 5 / 1000
    assert got[1]["stretch"] == pytest.approx(100 * 15 / width) and got[5]["stretch"] == 5


def test_an_engine_is_called_page_by_page(spark):
    from quire.sources import recogniser

    def engine(page, rows):
        assert {r["page"] for r in rows} == {page}
        for r in rows:
            yield (r["no"] * 10, f"{page}{r['no']} ", 1, 2, 3.0, 4, 50)
            yield (7, " ", 1, 2, 3, 4, 50)
            yield (7, "flat", 1, 2, 0, 4, 50)
            yield (7, "given up", 1, 2, 3, 4, -1)
            yield (7, None, 1, 2, 3, 4, 50)

    recogniser.register(spark, "engine_of_a_test", engine)
    parts = spark.createDataFrame([("b", 2), ("a", 3), ("a", 1), ("a", 1)], "page string, no int")
    sql = "SELECT * FROM engine_of_a_test(TABLE({parts}) PARTITION BY page ORDER BY no)"
    got = sorted((r["page"], r["seq"], r["line"], r["text"], r["confidence"]) for r in spark.sql(sql, parts=parts).collect())
    assert got == [("a", 1, 1, "a1", 50.0), ("a", 2, 1, "a1", 50.0), ("a", 3, 2, "a3", 50.0), ("b", 1, 1, "b2", 50.0)]
    assert spark.sql(sql, parts=parts.limit(0)).count() == 0


def test_a_page_of_several_batches_is_one_call(spark):
    """Parts reach the engine as Arrow batches, and a page that they cut is still one page."""
    from quire.sources import recogniser

    recogniser.register(spark, "counting_engine", lambda page, rows: [(1, f"{len(rows)}:{rows[0]['no']}", 0, 0, 1, 1, 1)])
    parts = spark.createDataFrame([(p, n) for p in "ab" for n in range(7, 0, -1)] + [(None, 1)], "page string, no int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        made = spark.sql("SELECT * FROM counting_engine(TABLE({parts}) PARTITION BY page ORDER BY no)", parts=parts)
        assert sorted((str(r["page"]), r["text"]) for r in made.collect()) == [("None", "1:1"), ("a", "7:1"), ("b", "7:1")]
        assert "ArrowEvalPythonUDTF" in made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
