"""Steps whose work has to stay in proportion to the rows: plans, parts and rows written, beside results by brute force."""

import random

from pyspark.sql import functions as F

from quire.functions import geometry
from quire.operators import closure, content, fields, graph, report
from quire.plans import scratch


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paper_reads_a_text_once(spark):
    names = ["", "A4", " 210 x 297mm ", "1x1in", "3 x 4 in", "half-letter", "8.5×11in", "100*200", "20001x30", "x", None, "10x20cm"]
    frame = spark.createDataFrame([(n,) for n in names], "n string").select("n", geometry.paper(F.col("n")).alias("s"))
    assert plan(frame).count("regexp_") < 8
    got = [tuple(r["s"]) if r["s"] else None for r in frame.collect()]
    mm = geometry.MM
    assert got == [(210 * mm, 297 * mm), (210 * mm, 297 * mm), (210 * mm, 297 * mm), (72.0, 72.0), (216.0, 288.0), (396.0, 612.0), (612.0, 792.0), (100.0, 200.0), None, None, None, (10 * 10 * mm, 20 * 10 * mm)]


def test_pages_fill_row_by_row(spark):
    random.seed(3)
    rows = [(k, i, random.choice((10.0, 22.0, 34.0, 46.0, 500.0))) for k in ("a", "b", None) for i in range(700)] + [("c", 1, 5.0), ("c", 2, None), ("c", 3, 999.0)]
    want = []
    last, page, used = [], 1, 20.0
    for k, i, h in rows:
        if last != [k]:
            last, page, used = [k], 1, 20.0
        if k == "c":
            want.append((k, i, 1))
            continue
        if used + h > 300 and used > 20:
            page, used = page + 1, 20.0
        used += h
        want.append((k, i, page))
    random.shuffle(rows)
    made = report.fill_pages(spark.createDataFrame(rows, "k string, i int, h double"), "k", "i", "h", 300.0, 20.0)
    assert "collect_list" not in plan(made) and made.schema.simpleString() == "struct<k:string,i:int,page:int>"
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)


def test_runs_go_on_across_spans(spark, monkeypatch):
    monkeypatch.setattr(graph, "SPAN", 8)
    monkeypatch.setattr(graph, "PART_ROWS", 50)
    random.seed(4)
    rows = [(k, v) for k in (1, 2, None) for v in random.sample(range(-150, 150), 220)] + [(3, v) for v in range(-20, 40)] * 2 + [(4, 7), (4, 8), (5, None)]
    want = []
    for k in {k for k, _ in rows}:
        run = []
        for v in sorted({v for j, v in rows if j == k and v is not None}):
            if run and v == run[-1][1] + 1:
                run[-1][1] = v
            else:
                run.append([v, v])
        want += [(k, *r) for r in run]
    got = graph.islands(spark.createDataFrame(rows, "k int, v long"), "k", "v")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*want, (5, None, None)], key=str)


def test_uses_of_shared_forms_are_found_once(spark, monkeypatch):
    """300 roots draw one chain of forms: what is written grows with roots and forms, not with their product."""
    written = []
    write = scratch.write

    def counted(df, name):
        out = write(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(content.scratch, "write", counted)
    rows = [(f"p{i}", 1, "Do", "f0", None) for i in range(300)]
    rows += [(f"f{k}", q, *op) for k in range(12) for q, op in enumerate([("Tf", f"F{k}", None), ("Tr", None, k % 4), ("Tj", None, None), ("Do", f"f{k + 1}", None)])]
    rows += [("f12", 1, "Tj", None, None), ("f12", 2, "Do", "f0", None), ("f13", 1, "k", None, None)]
    frame = spark.createDataFrame(rows, "stream string, seq int, op string, name string, number int")
    starts = spark.createDataFrame([(f"p{i}", f"p{i}", "r") for i in range(300)], "root string, stream string, scope string")
    forms = spark.createDataFrame([("r", f"f{k}", f"f{k}", None) for k in range(14)], "scope string, name string, stream string, own_scope string")
    fonts = spark.createDataFrame([("r", f"F{k}", f"font{k % 6}") for k in range(12)], "scope string, name string, font string")
    got = {tuple(r) for r in content.font_use(frame, starts, forms, fonts).collect()}
    # Form k is k + 1 levels below a root, so the twelfth form is out of reach.
    assert got == {(f"p{i}", f"font{k % 6}", k % 4 != 3, False) for i in range(300) for k in range(12)}
    assert max(written) <= 300 * 13


def test_cuts_of_closures_by_numbers(spark):
    """Random graphs with circles, roots that are no stops, references to nothing and back to the root."""
    random.seed(6)
    nodes = [f"n{i}" for i in range(40)]
    refs = [(random.choice(nodes), random.choice([*nodes, "gone", None])) for _ in range(140)] * 2 + [("n0", "n0"), (None, "n1")]
    refs = spark.createDataFrame(refs, "src string, dst string")
    roots = spark.createDataFrame([(n,) for n in [*nodes[:12], "n3", "outside"]], "root string")
    objects = spark.createDataFrame([(n,) for n in nodes[:36]], "node string")
    stops = spark.createDataFrame([(n,) for n in [*nodes[:9], *nodes[20:26]]], "node string")
    copied = closure.closures(refs, roots, objects, stops)
    edges, there = {}, {n for n in nodes[:36]} - {*nodes[:9], *nodes[20:26]}
    for s, d in {tuple(r) for r in refs.collect()}:
        edges.setdefault(s, []).append(d)
    want = set()
    for root in {*nodes[:12], "outside"}:
        depth, front = {root: 0}, [root]
        while front:
            front = [d for d in dict.fromkeys(d for s in front for d in edges.get(s, ()) if d in there) if depth.setdefault(d, max(depth[x] for x in front) + 1) and d not in front and depth[d] == max(depth[x] for x in front) + 1]
        want |= {(root, n, k) for n, k in depth.items()}
    assert {tuple(r)[:3] for r in copied.collect()} == want and len(want) > 60
    cuts = closure.closure_cuts(refs, roots, objects, stops)
    assert sorted(map(tuple, cuts.collect())) == sorted(map(tuple, closure.cut_references(refs, copied).collect()))


def test_crowded_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(fields, "PAIRS", 40)
    random.seed(7)
    rows = [(i % 2, i, *(float(random.randrange(40)) for _ in range(2)), float(random.randrange(1, 12)), 3.0) for i in range(300)] + [(0, 900, -50.0, -50.0, 500.0, 500.0)]
    frame = spark.createDataFrame([(p, i, (x, y, x + w, y + h)) for p, i, x, y, w, h in rows], "page int, id int, r struct<x0:double,y0:double,x1:double,y1:double>")
    a, b = frame.where("id % 3 = 0"), frame.where("id % 3 > 0")
    got = fields.overlaps(a, b)
    want = [(p, i, j) for p, i, x, y, w, h in rows if i % 3 == 0 for q, j, u, v, k, m in rows if j % 3 and p == q and x < u + k and u < x + w and y < v + m and v < y + h]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() > 1
