"""Functions against literal cases and properties."""

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import csvtext, fuzzy, htmltext, patterns, ranges, text
from quire.operators import fields, tables
from quire.operators.compare import lcs_diff


def test_ranges_keep_order_and_repeats():
    assert ranges.parse("2-4,3,last", 6) == [2, 3, 4, 3, 6]
    assert ranges.parse("", 2) == [1, 2]
    assert ranges.parse("5-3; even", 5) == [5, 4, 3, 2, 4]
    assert ranges.parse("-3,4-", 5) == [1, 2, 3, 4, 5]
    assert ranges.parse("end", 7) == [7]
    assert ranges.parse("-", 2) == [1, 2]
    for bad in ("0", "8", "2-3-4", "pg", "3-9"):
        with pytest.raises(ranges.RangeError):
            ranges.parse(bad, 7)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=20))
def test_range_format_round_trip(pages):
    assert ranges.parse(ranges.format_pages(pages), 30) == pages


def test_range_column_equals_parse(spark):
    for spec in ("2-4,3,last", "", "5-3; even", "-3,4-", "odd", "end"):
        got = spark.range(1, 7).select("id", ranges.pages_of(spec, F.col("id").cast("int")).alias("p")).collect()
        for r in got:
            try:
                want = ranges.parse(spec, r["id"])
            except ranges.RangeError:
                want = None
            assert r["p"] == want, (spec, r)


@pytest.mark.parametrize(
    ("kind", "line", "want"),
    [
        ("phone", "Ring the desk: +31 20 555 8071, or the porter's +46-8-123 456 78!", ["+31 20 555 8071", "+46-8-123 456 78"]),
        ("phone", "(0341) 66 20 19; 0171/3388219; 212.555.0188", ["(0341) 66 20 19", "0171/3388219", "212.555.0188"]),
        ("phone", "Lot 8817 weighs 90210.75 kg, made 2031-11-30, batch 55-19", []),
        ("phone", "pay into ES44 2100 4183 4502 0005 1332 please", []),
        ("iban", "Rent goes to NL62 RABO 0317 2044 59 each month", ["NL62 RABO 0317 2044 59"]),
        ("iban", "DE44500105175407324931, then ES4421004183450200051332 NOW", ["DE44500105175407324931", "ES4421004183450200051332"]),
        ("iban", "NL63 RABO 0317 2044 59 has a wrong sum", []),
        ("date", "Opened 2031-11-30; closed 7/4/2032.", ["2031-11-30", "7/4/2032"]),
        ("date", "from 21st March 2019 to May 9, 2020 and Sept. 2024", ["21st March 2019", "May 9, 2020", "Sept. 2024"]),
        ("date", "build 4.18.7, cell 19-99, 2031-13-01 and 45/45/2020", []),
        ("card", "charged 5217 3300 8046 1196 twice", ["5217 3300 8046 1196"]),
        ("card", "6011-2044-7730-5181/3714 490381 62004", ["6011-2044-7730-5181", "3714 490381 62004"]),
        ("card", "5217 3300 8046 1197, 6011-2044 7730 5181 1", []),
        ("email", "ask k_lind@post.example.se, not @post or k@post.", ["k_lind@post.example.se"]),
        ("email", "<o'neil%x@a-b.example>--", ["neil%x@a-b.example"]),
    ],
)
def test_patterns(spark, kind, line, want):
    got = spark.createDataFrame([(line,)], "t string").select(patterns.found_in(F.col("t"), kind).alias("x")).first()["x"]
    assert got == want


def test_text_functions(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], f"v {'double' if isinstance(value, float) else 'string'}").select(f(F.col("v")).alias("x")).first()["x"]

    assert [one(v, text.number_text) for v in (2.25, -0.0, 40.0, float("nan"))] == ["2.25", "0", "40", "0"]
    for cell in ("12,750", "-0.5", "(3,200)", "8 %", "£77.10", "6E-4", "¥ 900"):
        assert one(cell, text.is_number), cell
    for cell in ("", "twelve", "7 kg", "£", "--"):
        assert not one(cell, text.is_number), cell
    assert one('say "no" ', text.csv_field) == '"say ""no"" "' and one("simple", text.csv_field) == "simple"
    assert one("x\\y?z .", text.safe_name) == "x_y_z" and one(" . ", text.safe_name) == "part"
    assert one("m n+o/p~", text.percent_encode) == "m%20n%2Bo/p~" and one("m%20n+o", text.percent_decode) == "m n+o"
    assert one("ftp://host.example/dir?q", text.url_stem) == "host.example-dir-q" and one("?://", text.url_stem) == "page"
    assert one("D:20311130081507-03'00'", text.date_of_pdf) == "2031-11-30T08:15:07-03:00"
    assert one("2044", text.date_of_pdf) == "2044-01-01T00:00:00Z" and one("D:20440001", text.date_of_pdf) is None
    assert one("Lindens", lambda c: text.contains(c, "Linden", True, True)) is False
    assert one("the old LINDEN  tree", lambda c: text.contains(c, "linden", False, True)) is True
    assert [one(v, text.value_text) for v in (3.0000000001, 0.5, 12.346, -1.0)] == ["3", "0.5", "12.35", "-1"]
    assert one('<a b="c">&', text.xml_escape) == "&lt;a b=&quot;c&quot;&gt;&amp;"
    assert [one("long words", lambda c, n=n: text.ellipsis(c, n)) for n in (10, 6, 1, 0)] == ["long words", "long…", "…", ""]
    assert one("file://localhost/m%20n/o.html?x#y", text.path_of_file_url) == "/m n/o.html" and one("file:///p", text.path_of_file_url) == "/p"
    assert one("file://server/share", text.path_of_file_url) is None and one("http://x/y", text.path_of_file_url) is None
    assert one("/m n/o#p", text.file_url_of_path) == "file:///m%20n/o%23p"


def test_html_style_goes_before_any_closing_head(spark):
    got = spark.createDataFrame([("<html><HEAD ></head \n><body></body>",), ("<p>x</BODY  >",), ("y",)], "t string").select(htmltext.inject(F.col("t"), "B", "S").alias("x")).collect()
    assert [r["x"] for r in got] == ['<html><HEAD ><base href="B"><style>S</style></head \n><body></body>', '<base href="B"><p>x<style>S</style></BODY  >', '<base href="B">y<style>S</style>']


def test_csv():
    assert csvtext.parse('k;"l;""m""\r\nn";o\n\n7;8\r9', ";") == [["k", 'l;"m"\r\nn', "o"], ["7", "8"], ["9"]]
    assert csvtext.parse('5" pipe|x', "|") == [['5" pipe', "x"]]
    assert csvtext.parse("", ";") == []
    assert [csvtext.sniff(t) for t in ("k|l|m\n4|5|6", "k;l\n4;5", "", "k\tl\nm\tn")] == ["|", ";", ",", "\t"]
    assert csvtext.decode(b"\xef\xbb\xbfq") == "q" and csvtext.decode(b"\xfe\xff\0q") == "q" and csvtext.decode(b"\x85") == "…"
    assert csvtext.wrap("one two thirteen x", 7) == ["one two", "thirtee", "n x"] and csvtext.wrap("", 9) == [""]


@settings(max_examples=60)
@given(st.lists(st.lists(st.text("ab,;\"\n ", max_size=5), min_size=2, max_size=3), max_size=5))
def test_csv_round_trip(rows):
    written = "\r\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows)
    assert csvtext.parse(written, ",") == rows


@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_diff_is_minimal(a, b):
    removed, added = lcs_diff(a, b)
    table = {}

    def lcs(i, j):
        if (i, j) not in table:
            table[i, j] = 0 if i == len(a) or j == len(b) else lcs(i + 1, j + 1) + 1 if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))
        return table[i, j]

    assert len(removed) == len(a) - lcs(0, 0) and len(added) == len(b) - lcs(0, 0)


def test_fuzzy():
    assert fuzzy.score("", "anything") == 0 and fuzzy.score("  ", "") == 0
    assert fuzzy.score("q", "") is None and fuzzy.score("tr", "rotate") is None
    assert fuzzy.score("rot", "Rotate pages") > fuzzy.score("rot", "Carrot") > fuzzy.score("rot", "xxr o xxxxt")
    assert fuzzy.score("sp", "SplitPages") == fuzzy.score("s p", "splitPages") == 4 * (10 + 16 + 10 + 12) - 10
    assert fuzzy.score("tp", "twoPages") == 4 * (10 + 16 + 10 + 8 - 2 - 2) - 8


@settings(max_examples=200)
@given(st.text("abB- ", max_size=7), st.text("abB", min_size=1, max_size=3))
def test_fuzzy_by_trying_all_alignments(body, query):
    """Every way to place the letters, scored from the rule."""
    from itertools import combinations

    def worth(j):
        if j == 0:
            return 16
        return 10 if not body[j - 1].isalnum() else 8 if body[j - 1].islower() and body[j].isupper() else 0

    ways = []
    for at in combinations(range(len(body)), len(query)):
        if all(body[j].lower() == q.lower() for j, q in zip(at, query, strict=True)):
            total = 10 * len(at) + worth(at[0]) - min(at[0], 12)
            for i, j in zip(at, at[1:], strict=False):
                total += 12 if j == i + 1 else worth(j) - min(j - i - 1, 8) - 2
            ways.append(total * 4 - min(len(body), 60))
    assert fuzzy.score(query, body) == max(ways, default=None)


def page(rows):
    """Words of a page from (y, [(x, text), ...]); a letter is five wide."""
    return pd.DataFrame([("p", t, x, y, x + 5.0 * len(t), y + 10.7) for y, cells in rows for x, t in cells], columns=["page", "text", "x0", "y0", "x1", "y1"])


def test_tables_on_a_page():
    grid = [(100 + 14.0 * i, [(40.0, a), (140.0, b), (220.0, c)]) for i, (a, b, c) in enumerate([("Fruit", "Kilos", "Price"), ("plum", "12", "3.10"), ("quince", "7", ""), ("medlar", "140", "9.95")])]
    grid = [(y, [(x, t) for x, t in cells if t]) for y, cells in grid]
    prose = [(300 + 14.0 * i, [(40.0 + 30 * k, "words") for k in range(5)] + [(260.0 + 30 * k, "other") for k in range(5)]) for i in range(4)]
    title, below = [(60.0, [(40.0, "Stock in autumn")])], [(420.0, [(40.0, "k"), (200.0, "v")]), (434.0, [(40.0, "size"), (200.0, "9")])]
    found = tables.tables_of(page(title + grid + prose + below))
    assert found == [[["Fruit", "Kilos", "Price"], ["plum", "12", "3.10"], ["quince", "7", ""], ["medlar", "140", "9.95"]], [["k", "v"], ["size", "9"]]]
    assert tables.tables_of(page(title)) == [] and tables.tables_of(page(grid), min_rows=5) == [] and tables.tables_of(page([])) == []


def test_tables_take_time_in_proportion():
    import time

    start = time.process_time()
    (found,) = tables.tables_of(page([(14.0 * i, [(40.0, f"n{i}"), (140.0, "mid"), (220.0, "end")]) for i in range(3000)]))
    assert len(found) == 3000 and time.process_time() - start < 20


def test_renamed_fields_are_unique(spark):
    rows = [(1, "a"), (2, "a"), (3, "a_2"), (4, "a"), (5, "a_2"), (6, "b"), (7, "a_02")]
    got = {r["file_ord"]: r["new_name"] for r in fields.rename_clashes(spark.createDataFrame(rows, "file_ord long, name string")).collect()}
    assert got == {1: "a", 2: "a_3", 3: "a_2", 4: "a_4", 5: "a_2_2", 6: "b", 7: "a_02"}
