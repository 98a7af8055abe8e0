"""Named queries over resized pages, form fields and recognised words, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry, matrix
from quire.operators import forms
from quire.plans.library import S_LINES
from quire.plans.registry import query
from quire.plans.setting import _units
from quire.sources import bridge, recogniser
from quire.sources.bridge import table


@query("resized_annotations", """
    WITH p AS (SELECT p_partkey AS id, p_size AS x0, 10.0 AS y0, 300.0 + p_size AS x1, 410.0 + p_size * 2 AS y1, p_partkey % 4 AS k, ['fit', 'fill', 'stretch'][p_size % 3 + 1] AS fit, p_partkey % 3 = 0 AS keep FROM part),
    s AS (SELECT *, [1, 0, -1, 0][k + 1] AS co, [0, 1, 0, -1][k + 1] AS si, CASE WHEN k % 2 = 0 THEN x1 - x0 ELSE y1 - y0 END AS w, CASE WHEN k % 2 = 0 THEN y1 - y0 ELSE x1 - x0 END AS h FROM p),
    t AS (SELECT *, CASE WHEN keep AND (w > h) <> (595.0 > 842.0) THEN 842.0 ELSE 595.0 END AS tw, CASE WHEN keep AND (w > h) <> (595.0 > 842.0) THEN 595.0 ELSE 842.0 END AS th FROM s),
    z AS (SELECT *, CASE fit WHEN 'fit' THEN least(tw / w, th / h) WHEN 'fill' THEN greatest(tw / w, th / h) ELSE tw / w END AS sx, CASE fit WHEN 'fit' THEN least(tw / w, th / h) WHEN 'fill' THEN greatest(tw / w, th / h) ELSE th / h END AS sy FROM t),
    n AS (SELECT *, unnest([1, 2, 3]) AS i, unnest([x0 + 5, x1 - 9, x0]) AS x, unnest([y0 + 7, y1, y1 - 3]) AS y FROM z),
    v AS (SELECT *, x * co + y * si - least(x0 * co + y0 * si, x1 * co + y1 * si, x0 * co + y1 * si, x1 * co + y0 * si) AS vx, y * co - x * si - least(y0 * co - x0 * si, y1 * co - x1 * si, y1 * co - x0 * si, y0 * co - x1 * si) AS vy FROM n),
    q AS (SELECT *, vx * sx + (tw - w * sx) / 2 AS qx, vy * sy + (th - h * sy) / 2 AS qy FROM v),
    b AS (SELECT *, CASE k WHEN 0 THEN qx WHEN 1 THEN th - qy WHEN 2 THEN tw - qx ELSE qy END AS bx, CASE k WHEN 0 THEN qy WHEN 1 THEN qx WHEN 2 THEN th - qy ELSE tw - qx END AS by_ FROM q)
    SELECT id, any_value(CASE WHEN k % 2 = 0 THEN tw ELSE th END)::DOUBLE AS w, any_value(CASE WHEN k % 2 = 0 THEN th ELSE tw END)::DOUBLE AS h,
           array_to_string(list_transform(flatten(list([bx, by_] ORDER BY i)), lambda x: printf('%.3f', x + 1e-9)), ' ') AS points,
           round(min(bx) FILTER (WHERE i < 3), 4)::DOUBLE AS left_, round(max(by_) FILTER (WHERE i < 3), 4)::DOUBLE AS top FROM b GROUP BY id""")
def resized_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as turned pages brought to A4: the new page, the points and the rectangle of an annotation moved along."""
    s, key = F.col("p_size").cast("double"), F.col("p_partkey")
    box = geometry.rect(s, F.lit(10.0), 300.0 + s, 410.0 + s * 2)
    fit = F.get(F.array(*map(F.lit, ("fit", "fill", "stretch"))), (F.col("p_size") % 3).cast("int"))
    new = matrix.resized(box, key % 4 * 90, F.lit(595.0), F.lit(842.0), fit, key % 3 == 0)
    rows = table(spark, sf_dir, "part").select(key.alias("id"), new.alias("n"), s.alias("s"))
    points = F.array(F.col("s") + 5, F.lit(17.0), 291.0 + F.col("s"), 410.0 + F.col("s") * 2, F.col("s"), 407.0 + F.col("s") * 2)
    moved = matrix.map_points(F.col("n.move"), points)
    around = matrix.map_box(F.col("n.move"), geometry.rect(F.col("s") + 5, F.lit(17.0), 291.0 + F.col("s"), 410.0 + F.col("s") * 2))
    shown = F.array_join(F.transform(moved, lambda x: F.format_string("%.3f", x + 1e-9)), " ")
    return rows.select("id", F.col("n.box.x1").alias("w"), F.col("n.box.y1").alias("h"), shown.alias("points"), F.round(around["x0"], 4).alias("left_"), F.round(around["y1"], 4).alias("top"))


@query("annotation_pages", """
    WITH pages AS (SELECT n_nationkey AS page, n_nationkey + 1 AS page_no FROM nation), l AS (SELECT c_nationkey AS page, c_custkey % 700 AS id FROM customer),
    f AS (SELECT id, min(page_no) AS no FROM l JOIN pages USING (page) GROUP BY id)
    SELECT o_orderkey AS id, coalesce(f.no, p.page_no) AS page_no FROM orders LEFT JOIN f ON f.id = o_orderkey LEFT JOIN pages p ON p.page = o_custkey % 30""")
def annotation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as annotations: customers' nations list some of them, all name a page that may not exist."""
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), (F.col("n_nationkey") + 1).alias("page_no"))
    listed = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), (F.col("c_custkey") % 700).alias("id"))
    return forms.annotation_pages(listed, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("page")), pages)


S_FIELDS = """
    f AS (SELECT 'n' || n_nationkey AS node, NULL AS parent, false AS widget, false AS sig, false AS val FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey % 5 = 0, c_mktsegment = 'BUILDING', c_acctbal > 0 FROM customer
          UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, true, o_orderstatus = 'F', o_totalprice > 200000 FROM orders)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, customers and orders as a form: top fields, fields and widgets."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    no = F.lit(False)
    rows = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit(None).cast("string").alias("parent"), no.alias("widget"), no.alias("signature"), no.alias("has_value"))
    rows = rows.union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey") % 5 == 0, F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0))
    return rows.union(o.select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.lit(True), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000))


@query("settle_fields", f"""
    WITH RECURSIVE {S_FIELDS}, leaf AS (SELECT * FROM f WHERE node NOT IN (SELECT parent FROM f WHERE parent IS NOT NULL)),
    k AS (SELECT node FROM leaf WHERE NOT widget OR node IN (SELECT 'o' || l_orderkey FROM lineitem WHERE l_quantity > 45) UNION SELECT f.parent FROM k JOIN f USING (node) WHERE f.parent IS NOT NULL)
    SELECT node FROM k""")
def settle_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that stay when only pages with large items are taken."""
    held = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("o"), "l_orderkey").alias("node"))
    return forms.settle_fields(_fields(spark, sf_dir), held)


@query("signed_fields", f"""
    WITH RECURSIVE {S_FIELDS}, d AS (SELECT node AS top, node, sig AND val AS s FROM f WHERE parent IS NULL UNION ALL SELECT d.top, f.node, f.sig AND f.val FROM d JOIN f ON f.parent = d.node)
    SELECT top AS node, count(*) FILTER (WHERE s) AS signed FROM d GROUP BY top""")
def signed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures with a value below each top field."""
    return forms.signed_counts(_fields(spark, sf_dir))


@query("detach_places", """
    WITH f AS (SELECT 'F' || c_custkey AS field, ['text', 'choice', 'button'][c_custkey % 3 + 1] AS kind, 1 + c_custkey % 3 AS n FROM customer UNION ALL SELECT 'F' || c_custkey || ' 2', 'text', 1 FROM customer WHERE c_mktsegment = 'BUILDING'),
    p AS (SELECT min(o_orderkey) AS ord, 'F' || o_custkey AS field, 1 + o_orderkey % 3 AS place FROM orders GROUP BY ALL),
    a AS (SELECT p.*, kind, n, CASE WHEN kind IS NULL THEN 'no such field' WHEN place > n THEN 'no such place' WHEN kind = 'button' THEN 'cannot be filled by place' END AS problem FROM p LEFT JOIN f USING (field)),
    g AS (SELECT *, (field || ' 2') IN (SELECT field FROM f) AS two, list([ord, place]) FILTER (WHERE problem IS NULL AND n > 1) OVER (PARTITION BY field) AS others FROM a)
    SELECT field, place, 'v' || ord AS value, problem,
           CASE WHEN problem IS NOT NULL THEN NULL WHEN n = 1 THEN field
                WHEN NOT two THEN field || ' ' || place WHEN place = 1 THEN field || ' 1'
                WHEN place = 2 THEN field || CASE WHEN len(list_filter(others, lambda o: o[2] = 3 AND o[1] < ord)) > 0 THEN ' 4' ELSE ' 3' END
                ELSE field || CASE WHEN len(list_filter(others, lambda o: o[2] = 2 AND o[1] < ord)) > 0 THEN ' 4' ELSE ' 3' END END AS name FROM g""")
def detach_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fields in one to three places, orders as values for single places; second names of builders' fields are taken."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = F.col("c_custkey")
    fields = c.select(F.concat(F.lit("F"), key).alias("field"), F.get(F.array(*map(F.lit, ("text", "choice", "button"))), (key % 3).cast("int")).alias("kind"), (1 + key % 3).cast("int").alias("n_places"))
    fields = fields.union(c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("F"), key, F.lit(" 2")), F.lit("text"), F.lit(1)))
    places = o.groupBy(F.concat(F.lit("F"), "o_custkey").alias("field"), (1 + F.col("o_orderkey") % 3).cast("int").alias("place")).agg(F.min("o_orderkey").alias("ord"))
    return forms.detach_places(fields, places.withColumn("value", F.concat(F.lit("v"), "ord")))


@query("text_layer", f"""
    WITH w AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, l_linenumber // 3 AS line, p_name AS text, l_quantity * 10 AS x, l_linenumber * 40.0 AS y, 50.0 + l_partkey % 90 AS w, 8.0 + l_suppkey % 17 AS h
               FROM lineitem JOIN part ON p_partkey = l_partkey),
    m AS (SELECT *, CASE WHEN regexp_matches(text, '[gjpqy,;()\\[\\]{{}}|]') THEN 0.21::DOUBLE ELSE 0 END AS below, CASE WHEN regexp_matches(text, '[A-Z0-9bdfhklt()\\[\\]{{}}/|!?$%&#@]') THEN 0.72::DOUBLE ELSE 0.52::DOUBLE END AS above,
                 line <> coalesce(lag(line) OVER (PARTITION BY page ORDER BY seq), -1) AS new FROM w),
    r AS (SELECT *, sum(new::INT) OVER (PARTITION BY page ORDER BY seq) AS run, h / (above + below) AS s FROM m),
    z AS (SELECT *, list(s) OVER g AS ss, list(y + h - below * s) OVER g AS bs, seq = max(seq) OVER g AS last FROM r WINDOW g AS (PARTITION BY page, run)),
    o AS (SELECT *, least(greatest(list_sort(ss)[len(ss) // 2 + 1] / 2.5, 1), 800) AS size, list_sort(bs)[len(bs) // 2 + 1] / 2.5 AS base FROM z)
    SELECT page, seq, run::BIGINT AS run, trim(text) || CASE WHEN last THEN '' ELSE ' ' END AS shown, round(size, 4)::DOUBLE AS size,
           round(least(greatest(100 * (w / 2.5) / ({_units("trim(text)")} * size / 1000), 5), 2000), 3)::DOUBLE AS stretch, round(x / 2.5, 4)::DOUBLE AS x, round(842 - base, 4)::DOUBLE AS y FROM o WHERE trim(text) <> ''""")
def text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items as recognised words on a page for each order: runs, sizes, baselines and stretches."""
    from pyspark.sql.window import Window

    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    words = item.select(
        F.col("l_orderkey").alias("page"), seq.alias("seq"), F.floor(F.col("l_linenumber") / 3).alias("line"), F.col("p_name").alias("text"), (F.col("l_quantity") * 10).alias("x"),
        (F.col("l_linenumber") * 40.0).alias("y"), (50.0 + F.col("l_partkey") % 90).alias("w"), (8.0 + F.col("l_suppkey") % 17).alias("h"),
    )
    made = forms.text_layer(words, 2.5, 842.0)
    return made.withColumns({"size": F.round("size", 4), "stretch": F.round("stretch", 3), "x": F.round("x", 4), "y": F.round("y", 4)})


def _line_engine(page: object, rows: list) -> Iterator[tuple]:
    """An engine over text: a word's box has five pixels a letter and ten a line; numbers are given up."""
    for row in rows:
        x = 0
        for text in (row["text"] or "").split(" "):
            yield (row["line_no"], text, x * 5.0, row["line_no"] * 12.0, len(text) * 5.0, 10.0, -1.0 if text.isdigit() else 90.0)
            x += len(text) + 1


@query("recognised_words", f"""
    WITH {S_LINES.strip()}, s AS (SELECT doc_id || '/' || page_no AS page, line_no, string_split(text, ' ') AS ws FROM lines),
    w AS (SELECT page, line_no, unnest(range(1, len(ws) + 1)) AS i, ws FROM s),
    k AS (SELECT page, line_no, i, ws[i] AS text, 5.0::DOUBLE * (coalesce(list_sum(list_transform(ws[1:i - 1], lambda t: len(t) + 1)), 0)) AS x, line_no * 12.0::DOUBLE AS y, len(ws[i]) * 5.0::DOUBLE AS w FROM w
          WHERE NOT regexp_full_match(ws[i], '[0-9]+') AND trim(ws[i], chr(32) || chr(9) || chr(13)) <> '')
    SELECT page, row_number() OVER (PARTITION BY page ORDER BY line_no, i)::INTEGER AS seq, dense_rank() OVER (PARTITION BY page ORDER BY line_no)::INTEGER AS line,
           trim(text, chr(32) || chr(9) || chr(13)) AS text, x, y, w, 10.0::DOUBLE AS h, 90.0::DOUBLE AS confidence FROM k""")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pages through a recogniser that SQL calls."""
    recogniser.register(spark, "recognise_lines", _line_engine)
    lines = bridge.lines(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page_no").alias("page"), "line_no", "text")
    return spark.sql("SELECT * FROM recognise_lines(TABLE({lines}) PARTITION BY page ORDER BY line_no)", lines=lines)
