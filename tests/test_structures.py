"""Object structures on awkward input: twins, residue, page trees, closures, content."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import closure, content, objects, residue, trees, twins

REFS = "src long, slot string, dst long"


def merged(spark, rows, refs, **options):
    frame = spark.createDataFrame(rows, "id long, a string, b string, eligible boolean")
    return {r["id"]: (r["keep_id"], r["round"]) for r in twins.merge_twins(frame, spark.createDataFrame(refs, REFS), ["a", "b"], **options).collect()}


def test_twins_need_three_rounds(spark):
    rows = [(i, "abc"[i // 2 % 3], None, True) for i in range(6)]
    refs = [(2, "x", 0), (3, "x", 1), (4, "x", 2), (5, "x", 3)]
    assert merged(spark, rows, refs) == {1: (0, 1), 3: (2, 2), 5: (4, 3)}
    assert merged(spark, rows, refs, most_rounds=2) == {1: (0, 1), 3: (2, 2)}
    chain = [(i, f"k{i // 2}", None, True) for i in range(20)]
    assert len(merged(spark, chain, [(i, "x", i - 2) for i in range(2, 20)])) == 4
    assert len(merged(spark, chain, [(i, "x", i - 2) for i in range(2, 20)], most_rounds=None)) == 10


def test_forms_of_twins_are_not_ambiguous(spark, monkeypatch):
    rows = [(1, "a", "b1:c", True), (2, "a1:b", "c", True), (3, None, "", True), (4, "", None, True), (5, "-", "", True), (6, "x", "y", True), (7, "x", "y", False), (8, "x", "y", True), (9, "é", None, True), (10, "é", None, True)]
    assert merged(spark, rows, []) == {8: (6, 1), 10: (9, 1)}
    # Slots and targets count, in order of slots; dangling targets are what they are; equal hashes decide nothing.
    refs = [(6, "p", 99), (8, "p", 98), (9, "s", 1), (9, "t", 2), (10, "t", 2), (10, "s", 1)]
    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert merged(spark, rows, refs) == {10: (9, 1)}
    assert merged(spark, [], []) == {}


def test_merged_twins_follow_a_later_first_copy(spark):
    """3 goes to 2 at once; 2 equals 1 only when their references do."""
    rows = [(0, "n", None, True), (9, "n", None, True), (1, "a", None, True), (2, "a", None, True), (3, "a", None, True)]
    assert merged(spark, rows, [(1, "x", 0), (2, "x", 9), (3, "x", 9)]) == {9: (0, 1), 3: (1, 1), 2: (1, 2)}


def test_residue_of_ten_thousand_needles(spark, monkeypatch):
    monkeypatch.setattr(residue, "MOST_NEEDLE_BYTES", 20_000)  # several automata
    random.seed(2)
    words = ["".join(random.choices("abcdeé", k=random.randrange(2, 5))) for _ in range(3000)]
    texts = [(i, " ".join(random.choice((w, w.upper(), w.title())) for w in random.choices(words, k=12))) for i in range(60)]
    texts += [(100, "STRASSE Straße ΟΔΟΣ οδοσ İstanbul ıX a.c a+c"), (101, None), (102, ""), (103, "x" * 100_000 + "Tail")]
    odd = ["straße", "οδος", "ΟΔΟΣ", "istanbul", "ix", "a.c", "(", "\\E", "TAIL", "  a.c   a+c ", "", "ss"]
    needles = [(w, bool(k % 3 == 0), bool(k % 2)) for k, w in enumerate([f"{random.choice(words)} {random.choice(words)}" if k % 2 else random.choice(words) + str(k % 7) for k in range(10_000)] + words[:300] + odd * 4)]
    needles += [("straße", None, None), (None, True, False)]
    asked = spark.createDataFrame(needles, "needle string, match_case boolean, whole_words boolean")
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in residue.residue(spark.createDataFrame(texts, "id long, text string"), asked).collect()}
    frame = spark.createDataFrame(texts, "id long, text string").where("text is not null").cache()
    lower = [(i, (t or "").lower().upper().lower()) for i, t in texts]
    want = {}
    for n, case, whole in {(" ".join(n.split()), bool(c), bool(w)) for n, c, w in needles if n and n.split()}:
        plain = n in odd or " ".join(n.split()) in odd or "ß" in n or any(ord(x) > 300 for x in n)
        if plain or any(n.lower() in t for _, t in lower):  # the engine's own rule decides
            ids = [r["id"] for r in frame.where(text.contains(F.col("text"), n, case, whole)).select("id").collect()] if plain else [
                i for i, t in texts if t and re.search((r"(?<![^\W_])" if whole else "") + re.escape(n) + (r"(?![^\W_])" if whole else ""), t, 0 if case else re.I)]
            if ids:
                want[n, case, whole] = (len(ids), min(ids))
    assert got == want and len(want) > 200


RESIDUE = ("id long, text string", "needle string, match_case boolean, whole_words boolean")


def test_residue_sends_counts_and_no_text(spark, monkeypatch):
    """Texts that hold all needles: what is written grows with tasks and needles, not with their pairs."""
    wrote, write = {}, residue.scratch.write

    def counted(df, name):
        out = write(df, name)
        wrote[name] = out.count()
        return out

    monkeypatch.setattr(residue.scratch, "write", counted)
    needles = [(f"k{i} v{i}", i % 2 == 0, i % 3 == 0) for i in range(50)]
    texts = [(i, " ".join(n for n, _, _ in needles) + f" t{i}") for i in range(400)]
    frames = [spark.createDataFrame(x, schema).repartition(2) for x, schema in zip((texts, needles), RESIDUE, strict=True)]
    got = residue.residue(*frames).collect()
    assert sorted(map(tuple, got)) == sorted((*n, 400, 0) for n in needles)
    assert max(wrote.values()) <= 200


def test_residue_of_repeated_ids_and_of_windows_at_edges(spark, monkeypatch):
    monkeypatch.setattr(residue, "STEP", 16)
    monkeypatch.setattr(residue, "MOST_HELD", 3)
    texts = [(1, "Straße der ab"), (1, "STRAẞE ab"), (2, "xab ab"), (3, "ab"), (None, "ab"), (4, "abx"), (None, "zz"), (5, "straße"), (5, "aaa"), (6, "-" * 40 + "ab" * 30 + "."), (7, "ab"), (7, "AB"), (8, "\U0010ffffab😀b")]
    needles = [("STRAẞE", False, False), ("ab", True, True), ("ab", False, False), ("AB", True, False), ("zz", False, True), ("aa", False, True), ("aaa", None, True), ("ab" * 15, False, False), ("ab" * 30, True, True), ("b.", False, False), ("b\n ", False, True), ("😀B", False, False), ("r S", False, False)]
    got = residue.residue(*(spark.createDataFrame(x, schema).coalesce(1) for x, schema in zip((texts, needles), RESIDUE, strict=True)))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == {
        ("STRAẞE", False, False): (2, 1), ("ab", True, True): (5, 1), ("ab", False, False): (7, 1), ("AB", True, False): (1, 7), ("zz", False, True): (0, None),
        ("aaa", False, True): (1, 5), ("ab" * 15, False, False): (1, 6), ("ab" * 30, True, True): (1, 6), ("b.", False, False): (1, 6), ("b", False, True): (1, 8), ("😀B", False, False): (1, 8),
    }


def test_ascii_contains(spark):
    row = spark.createDataFrame([("xÉ Secret z",)], "t string").select(*(residue.ascii_contains(F.col("t"), F.lit(n), F.lit(c)).alias(str(i)) for i, (n, c) in enumerate([("secret", False), ("secret", True), ("Secret", True), ("é", False), ("", False)])))
    assert tuple(row.first()) == (True, False, True, False, False)


def brute_sums(rows):
    kids = {}
    for n, p, *_ in rows:
        kids.setdefault(p, []).append(n)
    by = {n: (w, ok) for n, _, w, ok in rows}

    def below(n):
        return sum(by[k][0] + (below(k) if by[k][1] is not False else 0) for k in kids.get(n, []))

    return {n: below(n) for n in by}


def test_subtree_sums(spark):
    random.seed(4)
    rows = [(0, None, 1, None), (1, 77, 5, True)] + [(i, random.randrange(max(0, i - 6), i), random.randrange(4), random.choice((True, True, False, None))) for i in range(2, 300)]
    frame = spark.createDataFrame(rows, "node long, parent long, w long, ok boolean")
    assert {r["node"]: r["total"] for r in trees.subtree_sums(frame, F.col("w"), F.col("ok")).collect()} == brute_sums(rows)
    assert trees.subtree_sums(frame.limit(0), F.col("w")).count() == 0


def test_a_deep_chain_ends_and_a_circle_raises(spark):
    chain = spark.range(10_000).selectExpr("id as node", "nullif(id, 0) - 1 as parent")
    got = trees.subtree_sums(chain, F.lit(1)).agg(F.max("total"), F.sum("total")).first()
    assert tuple(got) == (9999, 9999 * 10_000 // 2)
    with pytest.raises(RuntimeError):
        trees.subtree_sums(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), F.lit(1), deepest=64)


def test_visible_counts_far_down(spark):
    rows = [(f"i{k}", f"i{k - 1}" if k else None, k != 60) for k in range(150)]
    got = {r["node"]: r["n_visible"] for r in objects.visible_counts(spark.createDataFrame(rows, "node string, parent string, open boolean")).collect()}
    assert got["i0"] == 60 and got["i60"] == -89 and got["i148"] == 1 and "i149" not in got


def test_catalogues(spark):
    rows = [
        ("a", 1, "Catalog", True, False, None, None), ("a", 2, "Catalog", False, False, None, None), ("a", 3, "Pages", True, True, None, 9),
        ("b", 4, "Pages", False, True, None, 5), ("b", 5, "Pages", False, True, None, 5), ("b", 6, "Pages", False, True, 4, 50), ("b", 7, "Pages", False, False, None, 60),
        ("c", 8, "Font", None, None, None, None), ("d", 9, "Pages", False, True, None, None),
    ]
    frame = spark.createDataFrame(rows, "f string, id long, kind string, has_pages boolean, has_kids boolean, parent long, count long")
    assert {r["f"]: (r["root"], r["made"]) for r in trees.choose_catalogue(frame, "f").collect()} == {"a": (1, False), "b": (5, True), "c": (None, True), "d": (9, True)}


def test_closures_stop_at_pages(spark):
    refs = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "x"), ("x", "b"), ("b", "y"), ("a", "tree"), ("y", "gone"), ("a", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in ("a", "b", "x", "y", "tree")], "node string")
    stops = spark.createDataFrame([("a",), ("b",), ("tree",)], "node string")
    got = closure.closures(refs, spark.createDataFrame([("a",), ("b",), ("a",)], "root string"), nodes, stops)
    assert sorted(map(tuple, got.collect())) == [("a", "a", 0, 1), ("a", "x", 1, 2), ("a", "y", 2, 3), ("b", "b", 0, 1), ("b", "x", 2, 3), ("b", "y", 1, 2)]
    cut = closure.cut_references(refs, got)
    assert sorted(map(tuple, cut.collect())) == [("a", 4, 3), ("b", 4, 1)]
    deep = spark.range(30).selectExpr("id as src", "id + 1 as dst")
    with pytest.raises(RuntimeError):
        closure.closures(deep, spark.createDataFrame([(0,)], "root long"), spark.range(40).toDF("node"), spark.range(0).toDF("node"), most_rounds=10)


def test_font_use_through_forms(spark):
    ops = [
        ("page", ["q", "Tf:A", "Tj", "Do:in", "Q", "Tj", "Tr:3", "Tf:B", "Tj", "Do:own", "Do:none", "Tf:none", "Tj"]),
        ("in", ["Tj", "Tr:3", "Tj", "Tf:C", "Tj", "Do:in"]),  # C is not in the page's resources
        ("own", ["Tj", "Tf:C", "Tr", "'", "cs:DeviceCMYK"]),
        ("idle", ["Tf:A", "Q", "cs:DeviceRGB"]),
    ]
    rows = []
    for stream, steps in ops:
        for seq, step in enumerate(steps):
            op, _, arg = step.partition(":")
            rows.append((stream, seq, op, None if op == "Tr" else arg or None, int(arg) if op == "Tr" and arg else None))
    frame = spark.createDataFrame(rows, "stream string, seq int, op string, name string, number int")
    starts = spark.createDataFrame([("p1", "page", "r1"), ("p2", "idle", "r1"), ("p3", "nothing", "r1")], "root string, stream string, scope string")
    forms = spark.createDataFrame([("r1", "in", "in", None), ("r1", "own", "own", "r2")], "scope string, name string, stream string, own_scope string")
    fonts = spark.createDataFrame([("r1", "A", "fa"), ("r1", "B", "fb"), ("r2", "C", "fc")], "scope string, name string, font string")
    got = sorted(map(tuple, content.font_use(frame, starts, forms, fonts).collect()), key=str)
    # p1: A visibly on the page and at the form's start, invisibly in the form; B invisibly on the page and in its own
    # form; C visibly there. The form that draws itself starts again with no font.
    assert got == sorted([("p1", "fa", True, False), ("p1", "fa", False, False), ("p1", "fb", False, False), ("p1", "fc", True, False), ("p1", None, None, True)], key=str)


def test_a_walk_too_deep_raises(spark):
    from quire.operators import fields

    rows = spark.range(9).selectExpr("id as node", "nullif(id, 0) - 1 as parent", "concat('f', id) as label", "cast(null as string) as value")
    assert fields.walk(rows, 8).count() == 9
    with pytest.raises(RuntimeError):
        fields.walk(rows, 5)
