"""Awkward documents: nulls, empties, long texts, ties, repeats, and columns with clashing names."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n int, row string, lane string, slot int, "
    "prefix string, block string, blk int, doc string, t string, i int, id string, score int, ids string, queue string, "
    "_gone long, _twice int, _i int, _h long, _id int, k int, h long, k0 int, c0 string, _ int, part int, run int, edge string, hot int, at int, share int, p int, `no` int"
)


CLASH = (1, 2, 3, 4, 5, 6, 7, 8, "c", 9, 10, 11, "e", 12, 13, 14, 15, 16)


def awkward(spark, extra=()):
    long = " ".join(f"word{i % 977} x{i}" for i in range(20_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog again and again"),
        (2, "the QUICK brown fox jumps over the lazy dog again and again"),
        (3, None),
        (4, ""),
        (5, "   \t\n "),
        (6, "one two"),
        (7, "One  two"),
        (8, long),
        (9, long + " tail"),
        (9, long + " tail"),
        (None, "the quick brown fox jumps over the lazy dog again and again"),
        (None, None),
        (10, "É é ÉCOLE naïve 漢字 テスト 😀 straße"),
        (11, "é é ÉCOLE naïve 漢字 テスト 😀 straße"),
        (12, "a b c d e"),
        *extra,
    ]
    rows = [(i, t, "en", None if i == 6 else f"s{(i or 0) % 3}", len(t or ""), 5, "r", "l", 1, "p", "b", 2, "d", "t", 3, "x", 4, "y", "q", *CLASH) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
