"""Reports, marks in place, reading order and checks on awkward rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import compare, fields, layout, objects
from quire.sources import files


def lines_of(spark, texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts, 1)], "doc_id long, page_no int, line_no int, text string")


def test_unified_diff_keeps_two_lines_around_a_change(spark):
    old = lines_of(spark, ["red", "oak", "sea", "fog", "tin", "ash"])
    new = lines_of(spark, ["red", "oak", "sea", "fig", "tin", "ash"])
    assert [r["diff"] for r in compare.unified_diff(old, new).collect()] == ["@@ -2,5 +2,5 @@\n oak\n sea\n-fog\n+fig\n tin\n ash"]


def test_reports_of_equal_and_of_missing_versions(spark, tmp_path):
    rows = lines_of(spark, ["red", "oak"])
    none = rows.limit(0)
    assert compare.text_report(rows, rows).first()["report"] == "1 before; 1 after; nothing changed\n"
    gone = compare.page_report(rows, none)
    assert gone.first()["report"] == '{"doc_id":1,"old_pages":1,"new_pages":0,"changed":[1]}'
    assert compare.page_report(none, none).collect() == []
    files.write_reports(gone, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [gone.first()["report"]]


def test_an_output_must_not_be_an_input(tmp_path):
    taken = tmp_path / "a.csv"
    taken.write_text("x")
    files.guard_output([str(taken)], str(tmp_path / "b.csv"))
    with pytest.raises(ValueError):
        files.guard_output([str(taken)], str(tmp_path / "." / "a.csv"))


def test_language_codes(spark):
    tags = {"pt-BR": "por", " DE ": "deu", "zh-TW": "chi_tra", "zh": "chi_sim", "chi_sim": "chi_sim", "abc": "abc", "xx-YY": "xx-YY", "": "", None: None}
    got = spark.createDataFrame([(t,) for t in tags], "t string").select("t", text.language_code(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == tags


def test_password_problems(spark):
    cases = [("", None, True, "missing"), ("", "own", False, None), ("p" * 33, "", True, "length"), ("p" * 33, "", False, None), ("ü" * 64, "", False, "length"), ("a\n", "", True, "letters"), ("~ !", "", True, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "u string, o string, s boolean")
    assert [r[0] for r in df.select(text.password_problem(F.col("u"), F.col("o"), F.col("s"))).collect()] == [c[3] for c in cases]


def test_words_of_one_row_read_from_the_left(spark):
    words = [("p", "b", 50.0, 10.0, 20.0), ("p", "a", 5.0, 11.0, 21.0), ("p", "c", 5.0, 30.0, 40.0), ("q", "d", 1.0, None, None)]
    got = layout.reading_order(spark.createDataFrame(words, "page string, text string, x0 double, y0 double, y1 double"))
    assert {r["text"]: (r["row"], r["place"]) for r in got.collect()} == {"a": (1, 1), "b": (1, 2), "c": (2, 3), "d": (1, 1)}


def test_rows_do_not_depend_on_the_order_of_words_with_one_centre(spark):
    words = [("p", "a", 5.0, 0.0, 12.0), ("p", "a", 5.0, 1.0, 11.0), ("p", "b", 1.0, 5.5, 15.5)]
    for given in (words, [words[2], words[1], words[0]]):
        got = layout.reading_order(spark.createDataFrame(given, "page string, text string, x0 double, y0 double, y1 double").coalesce(1))
        assert sorted((r["y0"], r["row"], r["place"]) for r in got.collect()) == [(0.0, 1, 1), (1.0, 1, 2), (5.5, 2, 3)]


def test_equal_marks_of_a_line_have_places_of_their_own(spark):
    rows = lines_of(spark, ["none", "ab ab", None])
    got = layout.place_marks(rows, F.when(F.col("line_no") == 2, F.array(F.lit("ab"), F.lit("ab"))), 10).orderBy("mark_no").collect()
    assert [(r["mark_no"], r["x0"], r["x1"], r["y0"]) for r in got] == [(1, 0.0, 10.0, 14.0), (2, 15.0, 25.0, 14.0)]


def test_a_choice_shows_its_first_option(spark):
    options = spark.createDataFrame([("f", 2, "k", "late"), ("f", 1, "k", "early")], "field string, idx int, export string, display string")
    rows = [("f", "choice", ["k"]), ("f", "choice", ["z"]), ("f", "text", ["k", "", "m"]), ("f", "choice", None)]
    got = fields.display_values(spark.createDataFrame(rows, "field string, kind string, value array<string>"), options)
    assert sorted(r["shown"] for r in got.collect()) == ["", "early", "k, m", "z"]


def test_rules_are_counted_by_reason(spark):
    rows = [(1, "font", "Z", False), (1, "font", "Z", None), (1, "annotation", None, False), (2, "font", "Z", True)]
    got = {r["f"]: r for r in objects.rule_report(spark.createDataFrame(rows, "f int, kind string, name string, ok boolean"), "f").collect()}
    assert got[1]["summary"] == "fonts that the file lacks: Z; annotations without a look of their own: 1"
    assert got[2]["keepable"] and got[2]["summary"] == ""
