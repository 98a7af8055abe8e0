"""Files, reports and names; streams."""

from pyspark.sql import functions as F

from quire.operators import fields, layout
from quire.sources import files
from quire.streaming import search


def test_folder_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'x,"y ""z"""\r\n1,2\r\n')
    (tmp_path / "b.tsv").write_bytes("é\tü".encode("cp1252"))
    (tmp_path / "c.txt").write_bytes(b"a\0b")
    (tmp_path / "d.exe").write_bytes(b"no")
    (tmp_path / "sub").mkdir()
    found = files.folder(spark, f"file://{tmp_path}")
    assert sorted(r["name"] for r in found.collect()) == ["a.csv", "b.tsv", "c.txt"]
    rows = {(r["path"].rsplit("/", 1)[1], r["row_no"]): r for r in files.csv_rows(found).collect()}
    assert rows["a.csv", 1]["cells"] == ["x", 'y "z"'] and rows["a.csv", 2]["cells"] == ["1", "2"]
    assert rows["b.tsv", 1]["cells"] == ["é", "ü"] and rows["c.txt", 1]["error"]


def test_csv_text_and_names(spark):
    cells = [("p", 1, 1, 1, "a,b"), ("p", 1, 1, 2, 'q"'), ("p", 1, 2, 1, "1"), ("p", 1, 2, 2, " 2"), ("p", 2, 1, 1, "z")]
    df = spark.createDataFrame(cells, "page string, table_no int, row_no int, col_no int, text string")
    assert files.csv_text(df).first()["csv"] == '"a,b","q"""\r\n1," 2"\r\n\r\nz\r\n'
    names = spark.createDataFrame([("x.pdf", 1), ("X.pdf", 2), ("y", 3), ("y", 4)], "name string, ord int")
    assert {r["ord"]: r["unique"] for r in files.unique_names(names).collect()} == {1: "x.pdf", 2: "X (2).pdf", 3: "y", 4: "y (2)"}


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "to a.b@c.org now"), (2, "none"), (3, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    marks = search.marks_of_stream(search.file_stream(spark, f"{tmp_path}/in", "doc_id long, text string"), ["email"])
    search.run_to_parquet(marks, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [(r["doc_id"], r["label"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "a.b@c.org")]


def test_walk_leaves_out_cycles_and_orphans(spark):
    nodes = spark.createDataFrame([("a", None, "A", "v"), ("b", "a", "B", None), ("c", "b", "C", "w"), ("x", "y", "X", None), ("y", "x", "Y", None), ("o", "gone", "O", None)], "node string, parent string, label string, value string")
    assert {(r["node"], r["depth"], r["path"], r["value"]) for r in fields.walk(nodes).collect()} == {("a", 0, "A", "v"), ("b", 1, "A.B", "v"), ("c", 2, "A.B.C", "w")}


def test_glyph_lines_keep_their_first_baseline(spark):
    rows = [("p", i, ch, i * 5.0, i * 5.0 + 5, 20.0 + dy, 10.0, 0.0) for i, (ch, dy) in enumerate((("a", 0), ("b", 3), (" ", 4), ("c", 4.9), ("d", 5.1)))]
    words = layout.group_glyphs(spark.createDataFrame(rows, "page string, ord int, ch string, x0 double, x1 double, y double, size double, angle double"))
    assert [(r["line_no"], r["word_no"], r["text"]) for r in words.orderBy("line_no", "word_no").collect()] == [(1, 1, "ab"), (1, 2, "c"), (2, 1, "d")]


def test_truthy_and_visible(spark):
    df = spark.createDataFrame([(" YES ", 0), ("no", 2), ("x", 32), ("On", 4)], "t string, f int")
    assert [tuple(r) for r in df.select(fields.truthy(F.col("t")), fields.visible(F.col("f"))).collect()] == [(True, True), (False, False), (True, False), (True, True)]
