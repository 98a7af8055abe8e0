"""Glyph widths, appearances, sizes and options on awkward values."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import appearance, glyphs, options


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def units(text):
    return sum(glyphs.HELVETICA[ord(c) - 32] if 32 <= ord(c) < 127 else glyphs.OTHER for c in text)


def test_fitted_lines_by_brute_force(spark):
    random.seed(9)
    texts = ["", " ", "i", "W", "…", "é 漢 字", "a b  c   ", "\t\nx"] + ["".join(random.choices("iW mé.漢\U0001f600 ", k=random.randrange(1, 30))) for _ in range(150)]
    rows = [(t, float(random.randrange(0, 120)), random.choice((6.0, 8.0, 12.5))) for t in texts]
    got = one(spark, rows, "t string, most double, size double", glyphs.text_units(F.col("t")), glyphs.fit_line(F.col("t"), F.col("size"), F.col("most")))
    for (t, most, size), (n, label) in zip(rows, got, strict=True):
        assert n == units(t)
        room = int(most * 1000 / size)
        if units(t) <= room:
            assert label == t
        else:
            k = max((k for k in range(len(t) + 1) if units(t[:k]) + glyphs.OTHER <= room), default=0)
            assert label == (t[:k].rstrip(" \t\n") + "…" if k else ""), (t, most)
    assert one(spark, [(None,)], "t string", glyphs.text_units(F.col("t")), glyphs.fit_line(F.col("t"), 9.0, 50.0)) == [(None, None)]


@pytest.mark.parametrize(
    ("given", "size", "colour"),
    [
        ("/Helv 11 Tf 0 g", 11.0, "0 g"), ("/F 200 Tf 1 0 0 rg", 144.0, "1 0 0 rg"), ("/F x Tf .5 g 1 2 rg", 0.0, ".5 g"), ("0 0 0 1 k /A 9 Tf -3 Tf", 0.0, "0 0 0 1 k"),
        ("", 0.0, "0 g"), (None, 0.0, "0 g"), ("9 1 2 3 4 k", 0.0, "1 2 3 4 k"), ("12 Tf", 12.0, "0 g"), ("1 g 2 Tf\t3 g\n", 2.0, "3 g"), ("g rg k Tf", 0.0, "0 g"), ("1 1 x 1 rg", 0.0, "0 g"),
    ],
)
def test_appearances(spark, given, size, colour):
    assert one(spark, [(given,)], "t string", appearance.parse_appearance(F.col("t")).alias("a"))[0][0] == (size, colour)


def test_sizes_are_the_largest_that_fit(spark):
    random.seed(10)
    rows = [("x" * random.randrange(0, 60), random.randrange(1, 30), random.uniform(1, 300), random.uniform(1, 200)) for _ in range(200)]
    got = one(spark, rows, "t string, n int, w double, h double", appearance.block_size(F.col("n"), F.lit(0), F.col("w"), F.col("h")), appearance.line_size(F.col("t"), F.lit(0), F.col("w"), F.col("h")))
    for (t, n, w, h), (block, line) in zip(rows, got, strict=True):
        pad = min(max(2.0, 2.0), w / 4, h / 4)
        size = 12.0
        while size > 4 and n * size * 1.15 > max(h - 2 * pad, 1.0):
            size -= 0.5
        assert block == size
        most = min(max(h - 4, 4.0), 12.0)
        assert line == pytest.approx(max(min(most, max(w - 2 * pad, 1.0) * 1000 / units(t)), 4.0) if t else most)
    assert one(spark, [("a\nb",)], "t string", appearance.line_size(F.col("t"), F.lit(33), F.lit(9.0), F.lit(9.0)), appearance.block_size(F.lit(0), F.lit(7.5), F.lit(9.0), F.lit(9.0))) == [(33.0, 7.5)]


def test_options(spark):
    rows = [('{"b":1,"a":{"x":[1,2]},"@password":"s\\"x","@z":true,"Password2":"p","n":null}',), ("[1]",), ("x",), (None,), ('{"@password":""}',), ('{"@password":5,"é\\"":"ü"}',)]
    got = one(spark, rows, "t string", options.tool_options(F.col("t")), options.kept_options(F.col("t")), options.password(F.col("t")))
    assert got[0] == ('{"Password2":"p","a":{"x":[1,2]},"b":1,"n":null}', '{"a":{"x":[1,2]},"b":1,"n":null}', 's"x')
    assert got[1:5] == [("{}", "{}", None)] * 4 and got[5] == ('{"é\\"":"ü"}', '{"é\\"":"ü"}', None)


def test_windows_paths_and_their_urls(spark):
    from quire.functions import text

    rows = [
        ("C:\\Users\\Ana Maria\\a b#1.html", "file:///C:/Users/Ana%20Maria/a%20b%231.html", "C:\\Users\\Ana Maria\\a b#1.html"),
        ("\\\\?\\C:\\long\\path.html", "file:///C:/long/path.html", "C:\\long\\path.html"),
        ("\\\\?\\UNC\\srv\\share\\zoë.html", "file://srv/share/zo%C3%AB.html", "\\\\srv\\share\\zoë.html"),
        ("\\\\srv\\share\\50%.html", "file://srv/share/50%25.html", "\\\\srv\\share\\50%.html"),
        ("d:/mixed\\x", "file:///d:/mixed/x", "d:\\mixed\\x"),
        ("/home/me", None, None), ("relative\\x", None, None), ("", None, None), (None, None, None), ("\\\\.\\pipe", None, None),
    ]
    url = text.url_of_windows_path(F.col("p"))
    assert one(spark, [(p,) for p, _, _ in rows], "p string", url, text.windows_path_of_url(url)) == [(u, b) for _, u, b in rows]
    urls = [("FILE://LocalHost/C:/a?b",), ("file:///C|/a#x",), ("file:///home/me",), ("http://srv/share",), ("file://srv",), (None,)]
    assert [r[0] for r in one(spark, urls, "u string", text.windows_path_of_url(F.col("u")))] == ["C:\\a", "C:\\a", None, None, None, None]
