"""Named queries over glyph widths, appearances and options, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import appearance, glyphs, options, text
from quire.operators import objects
from quire.plans.registry import query
from quire.sources import csvfiles
from quire.sources.bridge import table


def _units(text: str) -> str:
    return f"coalesce(list_sum({_each(text)}), 0)"


def _each(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN ({glyphs.HELVETICA})[unicode(c) - 31] ELSE {glyphs.OTHER} END)"


@query("text_widths", f"""
    SELECT doc_id, {_units("text")}::BIGINT AS units, round({_units("source")} * 9 / 1000.0, 6)::DOUBLE AS width FROM documents""")
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of each document set as one line, and of its source's name at nine points."""
    return table(spark, sf_dir, "documents").select("doc_id", glyphs.text_units(F.col("text")).alias("units"), F.round(glyphs.text_width(F.col("source"), 9.0), 6).alias("width"))


@query("fit_lines", f"""
    WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS t, (30.0 + p_size) AS most FROM part),
    w AS (SELECT *, {_each("t")} AS ws, CAST(floor(most * 1000 / 8) AS BIGINT) AS room FROM p),
    n AS (SELECT *, list_max(list_filter(range(0, len(ws) + 1), lambda k: coalesce(list_sum(ws[1:k]), 0) <= room - {glyphs.OTHER})) AS n FROM w)
    SELECT p_partkey, CASE WHEN list_sum(ws) <= room THEN t WHEN coalesce(n, 0) = 0 THEN '' ELSE regexp_replace(t[1:n], '\\s+$', '') || '…' END AS label FROM n""")
def fit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts at eight points, shortened to a width of their own by glyph widths."""
    text = F.concat("p_name", F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", glyphs.fit_line(text, 8.0, 30.0 + F.col("p_size")).alias("label"))


@query("csv_glyph_widths", f"""
    WITH cells AS (SELECT p_brand, unnest([1, 2, 3]) AS col, unnest([p_name, p_type, p_partkey::VARCHAR]) AS text FROM part),
    b AS (SELECT p_brand, col, max({_units("text")} * 0.009) AS line, max(list_max(list_transform(string_split_regex(text, '\\s+'), lambda w: {_units("w")} * 0.009))) AS word FROM cells GROUP BY ALL),
    e AS (SELECT p_brand, col, line + 8 AS wish0, least(greatest(least(word, 140.0 / 3), 20) + 8, greatest(line + 8, 28)) AS need FROM b),
    f AS (SELECT p_brand, col, greatest(wish0, need) AS wish, need, sum(greatest(wish0, need)) OVER w AS aw, sum(need) OVER w AS an FROM e WINDOW w AS (PARTITION BY p_brand))
    SELECT p_brand, col, round(CASE WHEN aw <= 140 THEN wish WHEN an >= 140 THEN need * 140 / an ELSE need + (wish - need) / (aw - an) * (140 - an) END, 4)::DOUBLE AS width FROM f""")
def csv_glyph_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the columns of printed lists that share 140 points, by glyph widths at nine points."""
    own = F.array(F.col("p_name"), F.col("p_type"), F.col("p_partkey").cast("string"))
    cells = table(spark, sf_dir, "part").select("p_brand", F.posexplode(own).alias("pos", "text")).select("p_brand", (F.col("pos") + 1).alias("col"), "text")
    return objects.column_widths(cells, "p_brand", 140.0, measure=lambda t: glyphs.text_units(t) * 0.009).withColumn("width", F.round("width", 4))


@query("default_appearances", """
    WITH a AS (SELECT o_orderkey, '/F' || o_orderstatus || ' ' || CASE o_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN '-3' ELSE CAST(o_custkey % 200 AS VARCHAR) END || ' Tf '
                      || CASE o_custkey % 7 WHEN 0 THEN '.5 g' WHEN 1 THEN '1 0 ' || o_orderkey % 9 || ' rg' WHEN 2 THEN '0 .1 1e0 +1 k 0 g' WHEN 3 THEN '1 0 rg' WHEN 4 THEN '9 0 0 0 1 k' WHEN 5 THEN '1 x g 0 0 1 rg' ELSE '' END AS da FROM orders),
    t AS (SELECT *, list_filter(regexp_split_to_array(da, '\\s+'), lambda x: x <> '') AS ts FROM a),
    i AS (SELECT *, list_max(list_filter(range(1, len(ts) + 1), lambda k: ts[k] = 'Tf')) AS tf,
                 list_max(list_filter(range(1, len(ts) + 1), lambda k: (ts[k] = 'g' AND k > 1 AND TRY_CAST(ts[k - 1] AS DOUBLE) IS NOT NULL)
                    OR (ts[k] = 'rg' AND k > 3 AND len(list_filter(ts[k - 3:k - 1], lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL)) = 3)
                    OR (ts[k] = 'k' AND k > 4 AND len(list_filter(ts[k - 4:k - 1], lambda x: TRY_CAST(x AS DOUBLE) IS NOT NULL)) = 4))) AS c FROM t)
    SELECT o_orderkey, CASE WHEN coalesce(TRY_CAST(ts[tf - 1] AS DOUBLE), 0) > 0 THEN least(TRY_CAST(ts[tf - 1] AS DOUBLE), 144) ELSE 0 END AS size,
           CASE WHEN c IS NULL THEN '0 g' ELSE array_to_string(ts[c - CASE ts[c] WHEN 'g' THEN 1 WHEN 'rg' THEN 3 ELSE 4 END:c], ' ') END AS colour FROM i""")
def default_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and colour of an appearance made of each order, with wrong and missing operands."""
    by = F.col("o_custkey")
    size = F.when(by % 5 == 0, "x").when(by % 5 == 1, "-3").otherwise((by % 200).cast("string"))
    colours = [F.lit(".5 g"), F.concat(F.lit("1 0 "), (F.col("o_orderkey") % 9).cast("string"), F.lit(" rg")), F.lit("0 .1 1e0 +1 k 0 g"), F.lit("1 0 rg"), F.lit("9 0 0 0 1 k"), F.lit("1 x g 0 0 1 rg"), F.lit("")]
    da = F.concat(F.lit("/F"), "o_orderstatus", F.lit(" "), size, F.lit(" Tf "), F.get(F.array(*colours), (by % 7).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", appearance.parse_appearance(da).alias("a")).select("o_orderkey", "a.*")


@query("field_sizes", f"""
    WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 30 ELSE 0 END AS given, (20 + c_custkey % 120)::DOUBLE AS w, (6 + c_custkey % 20)::DOUBLE AS h FROM customer),
    p AS (SELECT *, least(greatest(2.0, 1.0 + 1), w / 4, h / 4) AS pad, {_units("c_name")} AS u FROM c)
    SELECT c_custkey, round(CASE WHEN given > 0 THEN given ELSE greatest(least(greatest(4, least(12, h - 4)), greatest(w - 2 * pad, 1) * 1000 / u), 4) END, 6)::DOUBLE AS line_size,
           (CASE WHEN given > 0 THEN given ELSE greatest(least(floor(greatest(h - 2 * pad, 1) / (2 * 1.15) * 2) / 2, 12), 4) END)::DOUBLE AS block_size FROM p""")
def field_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font sizes of customers' names in boxes: on one line, and as two lines."""
    key = F.col("c_custkey")
    given, w, h = F.when(key % 4 == 0, key % 30).otherwise(0), (key % 120 + 20).cast("double"), (key % 20 + 6).cast("double")
    line = F.round(appearance.line_size(F.col("c_name"), given, w, h).cast("double"), 6)
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line_size"), appearance.block_size(F.lit(2), given, w, h).cast("double").alias("block_size"))


@query("run_options", """
    WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type, user_id FROM events)
    SELECT event_id, '{"Dpi":' || user_id || ',"kind":"' || event_type || '","userPassword":"u","value":' || k || '}' AS tool, '{"Dpi":' || user_id || ',"kind":"' || event_type || '","value":' || k || '}' AS kept,
           CASE WHEN user_id % 2 = 0 THEN event_type END AS password FROM e""")
def run_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as options of a run: what the tool gets, what is remembered, and the password."""
    value = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit('{"value": '), value, F.lit(', "@item": [1, {"x": 2}], "kind": "'), "event_type", F.lit('", "userPassword": "u", "Dpi": '), F.col("user_id").cast("string"),
        F.lit(', "@password": "'), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise(""), F.lit('"}'),
    )
    got = table(spark, sf_dir, "events").select("event_id", text.alias("o"))
    return got.select("event_id", options.tool_options(F.col("o")).alias("tool"), options.kept_options(F.col("o")).alias("kept"), options.password(F.col("o")).alias("password"))


S_TABLES = """
    c AS (SELECT p_brand AS file, p_size AS page, 3 * (p_partkey % 2) AS table_no, p_partkey AS row_no, '"' || replace(p_name || ', "' || p_size || '"', '"', '""') || '",' || p_type || ',' || p_partkey AS line FROM part),
    t AS (SELECT file, page, table_no, string_agg(line, chr(13) || chr(10) ORDER BY row_no) || chr(13) || chr(10) AS body FROM c GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables: a file for each brand, a page for each size, odd and even parts apart."""
    named = F.concat("p_name", F.lit(', "'), F.col("p_size").cast("string"), F.lit('"'))
    own = F.array(named, F.col("p_type"), F.col("p_partkey").cast("string"))
    cells = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("page"), (F.col("p_partkey") % 2 * 3).alias("table_no"), F.col("p_partkey").alias("row_no"), F.posexplode(own).alias("pos", "text"))
    return cells.select("file", "page", "table_no", "row_no", (F.col("pos") + 1).alias("col_no"), "text")


@query("csv_table_files", f"""
    WITH {S_TABLES} SELECT file || '-p' || page || '-t' || row_number() OVER (PARTITION BY file, page ORDER BY table_no) || '.csv' AS name, body AS csv FROM t""")
def csv_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of delimited text for each table."""
    return csvfiles.table_files(_cells(spark, sf_dir))


@query("csv_single_files", f"""
    WITH {S_TABLES} SELECT file || '-tables.csv' AS name, string_agg(body, chr(13) || chr(10) ORDER BY page, table_no) AS csv FROM t GROUP BY file""")
def csv_single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of a file in one text."""
    return csvfiles.table_files(_cells(spark, sf_dir), single_file=True)


@query("windows_urls", """
    WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'C:/My Docs/' WHEN 1 THEN '//?/D:/' WHEN 2 THEN '//server/a b/' ELSE '/home/' END || c_name || '%/x y.html' AS s FROM customer),
    u AS (SELECT *, replace(s, '//?/', '') AS t FROM p),
    e AS (SELECT *, CASE c_custkey % 4 WHEN 3 THEN NULL WHEN 2 THEN 'file:' ELSE 'file:///' END || replace(replace(replace(t, '%', '%25'), ' ', '%20'), '#', '%23') AS url FROM u)
    SELECT c_custkey, url, CASE WHEN url IS NOT NULL THEN replace(t, '/', chr(92)) END AS path FROM e""")
def windows_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' files on drives, long paths and shares: their addresses, and the paths read back from them."""
    kind, slash = F.col("c_custkey") % 4, F.lit("\\")
    start = F.when(kind == 0, "C:/My Docs/").when(kind == 1, "//?/D:/").when(kind == 2, "//server/a b/").otherwise("/home/")
    path = F.replace(F.concat(start, "c_name", F.lit("%/x y.html")), F.lit("/"), slash)
    made = table(spark, sf_dir, "customer").select("c_custkey", text.url_of_windows_path(path).alias("url"))
    return made.withColumn("path", text.windows_path_of_url(F.concat("url", F.lit("?q=1#top"))))
