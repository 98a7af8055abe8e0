"""Named queries of reports, reading order, checks and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.functions.patterns import found_in
from quire.operators import compare, fields, layout, objects
from quire.plans.library import S_LINES, S_NEW
from quire.plans.registry import query
from quire.sources import bridge
from quire.sources.bridge import LINES_PER_PAGE, table


@query("reading_order", """
    WITH w AS (SELECT l_orderkey AS page, l_linenumber, (l_partkey % 500)::DOUBLE AS x0, (l_linenumber * 4 + l_suppkey % 5)::DOUBLE AS y0,
                      (l_linenumber * 4 + l_suppkey % 5 + 10 + l_partkey % 3)::DOUBLE AS y1, l_returnflag || l_linenumber AS text FROM lineitem),
    m AS (SELECT *, (y0 + y1) / 2 AS mid, y1 - y0 AS size FROM w),
    f AS (SELECT *, CASE WHEN mid - lag(mid) OVER d > 0.4::DOUBLE * greatest(size, lag(size) OVER d) THEN 1 ELSE 0 END AS fresh FROM m
          WINDOW d AS (PARTITION BY page ORDER BY mid, x0, text)),
    r AS (SELECT *, (1 + sum(fresh) OVER (PARTITION BY page ORDER BY mid, x0, text))::INT AS row FROM f)
    SELECT page, l_linenumber, row, row_number() OVER (PARTITION BY page ORDER BY row, x0, mid, text)::INT AS place FROM r""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items as words of a page each, at uneven heights."""
    top = F.col("l_linenumber") * 4 + F.col("l_suppkey") % 5
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), "l_linenumber", (F.col("l_partkey") % 500).cast("double").alias("x0"), top.cast("double").alias("y0"),
        (top + 10 + F.col("l_partkey") % 3).cast("double").alias("y1"), F.concat("l_returnflag", "l_linenumber").alias("text"),
    )
    return layout.reading_order(words).select("page", "l_linenumber", "row", "place")


@query("placed_marks", f"""
    WITH {S_LINES},
    e AS (SELECT *, regexp_extract_all(text, '([A-Za-z0-9_%+\\-][A-Za-z0-9._%+\\-]*@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}})[.\\-]*(?:[^A-Za-z0-9.\\-]|$)', 1) AS labels FROM lines),
    u AS (SELECT doc_id, page_no, line_no, text, unnest(labels) AS label, unnest(range(1, len(labels) + 1)) AS i FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, label ORDER BY i) AS k FROM u),
    p AS (SELECT *, list_sum(list_transform(string_split(text, label)[1:k], lambda s: len(s))) + (k - 1) * len(label) AS pos FROM k),
    r AS (SELECT doc_id, page_no, label, pos * 5.0::DOUBLE AS x0, (line_no - 1) % 10 * 14.0::DOUBLE AS y0, (pos + len(label)) * 5.0::DOUBLE AS x1,
                 (line_no - 1) % 10 * 14.0::DOUBLE + 14 AS y1 FROM p)
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, y0, x0) AS mark_no FROM r""")
def placed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail marks with their rectangles, in page order."""
    rows = bridge.lines(spark, sf_dir)
    return layout.place_marks(rows, found_in(F.col("text"), "email"), LINES_PER_PAGE)


@query("display_values", """
    WITH f AS (SELECT c_custkey, c_nationkey % 5 AS field, CASE WHEN c_custkey % 3 = 0 THEN 'text' ELSE 'choice' END AS kind,
                      CASE WHEN c_custkey % 4 = 0 THEN ['N' || c_nationkey, '', c_mktsegment] ELSE ['N' || c_nationkey] END AS value FROM customer),
    j AS (SELECT *, array_to_string(list_filter(value, lambda v: v <> ''), ', ') AS joined FROM f)
    SELECT c_custkey, CASE WHEN kind = 'choice' THEN coalesce(n_name, joined) ELSE joined END AS shown
    FROM j LEFT JOIN nation ON n_regionkey = field AND 'N' || n_nationkey = joined""")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fields show; nations are the options of their region's field."""
    code = F.concat(F.lit("N"), "c_nationkey")
    value = F.when(F.col("c_custkey") % 4 == 0, F.array(code, F.lit(""), "c_mktsegment")).otherwise(F.array(code))
    own = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 5).alias("field"), F.when(F.col("c_custkey") % 3 == 0, "text").otherwise("choice").alias("kind"), value.alias("value")
    )
    options = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("field"), F.col("n_nationkey").alias("idx"), F.concat(F.lit("N"), "n_nationkey").alias("export"), F.col("n_name").alias("display")
    )
    return fields.display_values(own, options).select("c_custkey", "shown")


@query("rule_report", """
    WITH r AS (SELECT l_orderkey, 'F' || l_suppkey % 5 AS name, l_linenumber % 3 AS kind FROM lineitem WHERE l_quantity < 20),
    a AS (SELECT o.l_orderkey, coalesce(list_sort(list(DISTINCT name) FILTER (WHERE kind = 0)), []) AS names, count(*) FILTER (WHERE kind = 1) AS colours,
                 count(*) FILTER (WHERE kind = 2) AS bare FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN r ON r.l_orderkey = o.l_orderkey GROUP BY o.l_orderkey)
    SELECT l_orderkey, array_to_string(names, ', ') AS fonts, colours > 0 AS cmyk, bare AS bare_annotations, len(names) = 0 AND colours = 0 AND bare = 0 AS keepable,
           concat_ws('; ', CASE WHEN len(names) > 0 THEN 'fonts that the file lacks: ' || array_to_string(names, ', ') END,
                     CASE WHEN colours > 0 THEN 'colours outside any profile: ' || colours END, CASE WHEN bare > 0 THEN 'annotations without a look of their own: ' || bare END) AS summary
    FROM a""")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items as the fonts, colours and annotations of a file each."""
    kind = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(kind == 0, "font").when(kind == 1, "colour").otherwise("annotation").alias("kind"), F.concat(F.lit("F"), F.col("l_suppkey") % 5).alias("name"), (F.col("l_quantity") >= 20).alias("ok")
    )
    return objects.rule_report(rows, "l_orderkey")


@query("language_codes", """
    WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang || '-US' WHEN 1 THEN ' ' || lang WHEN 2 THEN 'deu' WHEN 3 THEN 'zh-Hant' WHEN 4 THEN 'eng+fra' ELSE upper(lang) || '-x' END AS tag, doc_id % 6 AS way, lang FROM documents)
    SELECT doc_id, CASE WHEN way = 2 THEN 'deu' WHEN lang IS NOT NULL AND way IN (0, 1, 5) AND lang = 'zh' THEN 'chi_sim' WHEN way = 3 THEN 'chi_tra' WHEN way = 4 THEN 'eng+fra' ELSE coalesce(code, trim(tag)) END AS code
    FROM t LEFT JOIN (VALUES ('en', 'eng'), ('de', 'deu'), ('fr', 'fra'), ('es', 'spa'), ('it', 'ita'), ('pt', 'por'), ('nl', 'nld'), ('ru', 'rus'), ('ja', 'jpn')) v(l, code) ON v.l = t.lang""")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    way, lang = F.col("doc_id") % 6, F.col("lang")
    tag = F.when(way == 0, F.concat(lang, F.lit("-US"))).when(way == 1, F.concat(F.lit(" "), lang)).when(way == 2, "deu")
    tag = tag.when(way == 3, "zh-Hant").when(way == 4, "eng+fra").otherwise(F.concat(F.upper(lang), F.lit("-x")))
    return table(spark, sf_dir, "documents").select("doc_id", text.language_code(tag).alias("code"))


@query("password_checks", """
    WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_name || 'é' ELSE repeat(c_name, 8) END AS pass,
                      CASE WHEN c_custkey % 8 = 4 THEN 'owner' ELSE '' END AS owner, c_nationkey % 2 = 0 AS short FROM customer)
    SELECT c_custkey, CASE WHEN pass = '' AND owner = '' THEN 'missing' WHEN short AND NOT regexp_full_match(pass || owner, '[ -~]*') THEN 'letters'
                           WHEN octet_length(encode(pass)) > CASE WHEN short THEN 32 ELSE 127 END THEN 'length' END AS problem FROM p""")
def password_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    way, name = F.col("c_custkey") % 4, F.col("c_name")
    user = F.when(way == 0, "").when(way == 1, name).when(way == 2, F.concat(name, F.lit("é"))).otherwise(F.repeat(name, F.lit(8)))
    owner = F.when(F.col("c_custkey") % 8 == 4, "owner").otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", text.password_problem(user, owner, F.col("c_nationkey") % 2 == 0).alias("problem"))


@query("page_report", f"""
    WITH {S_NEW},
    o AS (SELECT doc_id, page_no, list(text ORDER BY line_no) AS t FROM lines GROUP BY ALL), n AS (SELECT doc_id, page_no, list(text ORDER BY line_no) AS t FROM newer GROUP BY ALL),
    b AS (SELECT doc_id, count(o.t) AS old_pages, count(n.t) AS new_pages,
                 coalesce(list(page_no ORDER BY page_no) FILTER (WHERE o.t IS DISTINCT FROM n.t), []) AS changed FROM o FULL JOIN n USING (doc_id, page_no) GROUP BY doc_id)
    SELECT doc_id, old_pages, new_pages, '{{"doc_id":' || doc_id || ',"old_pages":' || old_pages || ',"new_pages":' || new_pages || ',"changed":[' || array_to_string(changed, ',') || ']}}' AS report FROM b""")
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON reports of two versions, one line each."""
    old = bridge.lines(spark, sf_dir)
    return compare.page_report(old, bridge.new_version(old)).drop("changed")


@query("text_report")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text reports of two versions with unified diffs."""
    old = bridge.lines(spark, sf_dir)
    return compare.text_report(old, bridge.new_version(old))
