"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import csvtext, fuzzy, geometry, htmltext, text
from quire.functions.patterns import found_in, may_hold
from quire.functions.ranges import format_ranges
from quire.operators import arrange, compare, fields, graph, layout, report, tables
from quire.plans.registry import query
from quire.sources import bridge
from quire.sources.bridge import table

# SQL building blocks.
S_LINES = """
    split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, (i - 1) // 10 + 1 AS page_no, i AS line_no, parts[i] AS text
              FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split))"""
S_DOCS = """
    docs AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines,
                    (len(string_split(text, chr(10))) + 9) // 10 AS n_pages FROM documents)"""
S_PAGES = S_DOCS + """,
    pg AS (SELECT doc_id, n_pages, unnest(range(1, n_pages + 1)) AS page_no FROM docs)"""
S_NEW = S_LINES + """,
    kept AS (SELECT * FROM lines WHERE NOT (doc_id % 5 = 0 AND line_no = 3)),
    newer AS (SELECT * FROM kept UNION ALL
              SELECT doc_id, max(line_no) // 10 + 1, max(line_no) + 1, 'appended line' FROM kept WHERE doc_id % 7 = 0 GROUP BY doc_id)"""


@query("find_marks", f"""
    WITH {S_LINES},
    e AS (SELECT doc_id, page_no, 'email' AS pattern,
                 unnest(regexp_extract_all(text, '([A-Za-z0-9_%+\\-][A-Za-z0-9._%+\\-]*@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}})[.\\-]*(?:[^A-Za-z0-9.\\-]|$)', 1)) AS label
          FROM lines)
    SELECT doc_id, page_no, pattern, count(*) AS n_marks, min(label) AS first_label FROM e GROUP BY ALL""")
def find_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail marks counted by page; entry's query."""
    return marks(spark, sf_dir, ["email"])


def marks(spark: SparkSession, sf_dir: str, patterns: list[str]) -> DataFrame:
    rows = bridge.lines(spark, sf_dir).where(may_hold(F.col("text"), patterns))
    each = F.array(*(F.struct(F.lit(p).alias("pattern"), found_in(F.col("text"), p).alias("labels")) for p in patterns))
    found = rows.select("doc_id", "page_no", F.explode(each).alias("m")).select("doc_id", "page_no", "m.pattern", F.explode("m.labels").alias("label"))
    return found.groupBy("doc_id", "page_no", "pattern").agg(F.count("*").alias("n_marks"), F.min("label").alias("first_label"))


@query("find_all_patterns")
def find_all_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five finders; dates, phones and IBANs in Arrow UDFs behind native filters."""
    return marks(spark, sf_dir, ["email", "card", "iban", "phone", "date"])


@query("mask_marks")
def mask_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with addresses and cards, blacked out with as many blocks as letters."""
    rows = bridge.lines(spark, sf_dir)
    labels = F.concat(found_in(F.col("text"), "email"), found_in(F.col("text"), "card"))
    out = F.aggregate("labels", F.col("text"), lambda t, x: F.replace(t, x, F.repeat(F.lit("█"), F.char_length(x))))
    return rows.withColumn("labels", labels).where(F.size("labels") > 0).select("doc_id", "line_no", out.alias("text"), F.size("labels").alias("n_marks"))


@query("quick_info", """
    SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, (len(string_split(text, chr(10))) + 9) // 10 AS n_pages,
           octet_length(encode(text)) AS n_bytes, string_split(text, chr(10))[1] AS title FROM documents""")
def quick_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(parts).alias("n_lines"), F.ceil(F.size(parts) / 10).alias("n_pages"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.get(parts, F.lit(0)).alias("title"),
    )


def _select(name: str, spec: str, sql: str, rule: str = "keep"):
    @query(name, f"WITH {S_PAGES} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return arrange.select_pages(bridge.documents_with_pages(spark, sf_dir), spec, rule)

    return run


_select("range_select", "1-2,1", """SELECT doc_id, u.i AS ord, u.p AS page_no FROM docs,
    (VALUES (1, 1), (2, 2), (3, 1)) u(i, p) WHERE n_pages >= 2""")
_select("range_select_desc", "last-1", "SELECT doc_id, n_pages - page_no + 1 AS ord, page_no FROM pg")
_select("range_odd_last", "odd,last", """SELECT doc_id, (page_no + 1) // 2 AS ord, page_no FROM pg WHERE page_no % 2 = 1
    UNION ALL SELECT doc_id, (n_pages + 1) // 2 + 1, n_pages FROM docs""")
_select("range_keep_first", "last,all", """SELECT doc_id, CASE WHEN page_no = n_pages THEN 1 ELSE page_no + 1 END AS ord, page_no FROM pg""", "first")
_select("range_sorted", "last,2,1", """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS ord, page_no
    FROM pg WHERE n_pages >= 2 AND (page_no <= 2 OR page_no = n_pages)""", "sorted")


@query("range_format", f"""
    WITH {S_PAGES} SELECT doc_id, CASE WHEN n_pages = 1 THEN '1' WHEN n_pages = 2 THEN '2, 1'
        WHEN n_pages = 3 THEN '2-3, 1' ELSE '2-' || n_pages || ', 1' END AS ranges FROM docs""")
def range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a page order (2 to last, then 1), by neighbours."""
    pages = bridge.documents_with_pages(spark, sf_dir)
    order = F.when(F.col("n_pages") > 1, F.concat(F.sequence(F.lit(2), "n_pages"), F.array(F.lit(1)))).otherwise(F.array(F.lit(1)))
    rows = pages.select("doc_id", F.posexplode(order).alias("ord", "page_no"))
    return format_ranges(rows)


@query("split_every", f"WITH {S_PAGES} SELECT doc_id, (page_no - 1) // 2 + 1 AS part, page_no FROM pg")
def split_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.split_every(bridge.documents_with_pages(spark, sf_dir), 2)


@query("split_ranges", f"""
    WITH {S_PAGES} SELECT doc_id, 1 AS part, 1 AS ord, 1 AS page_no FROM docs
    UNION ALL SELECT doc_id, 2, page_no - 1, page_no FROM pg WHERE n_pages >= 2 AND page_no >= 2
    UNION ALL SELECT doc_id, 3, n_pages - page_no + 1, page_no FROM pg""")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.split_ranges(bridge.documents_with_pages(spark, sf_dir), ["1", "2-", "last-1"])


@query("split_uncovered", f"WITH {S_PAGES} SELECT doc_id, page_no FROM pg WHERE page_no <> 1 AND page_no <> n_pages")
def split_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.uncovered(bridge.documents_with_pages(spark, sf_dir), ["1", "last"])


@query("split_part_names", f"""
    WITH {S_PAGES} SELECT doc_id, page_no AS part,
        'doc_' || doc_id || '-' || lpad(page_no::VARCHAR, greatest(len(n_pages::VARCHAR), len(page_no::VARCHAR))::INTEGER, '0') AS file FROM pg""")
def split_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bridge.doc_pages(spark, sf_dir).select("doc_id", F.col("page_no").alias("part"), F.col("n_pages").alias("n_parts"))
    return arrange.part_names(pages, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))


@query("pages_reorder", f"""
    WITH {S_PAGES}, o AS (
        SELECT doc_id, n_pages, 1 AS pos, n_pages AS page_no FROM docs
        UNION ALL SELECT doc_id, n_pages, page_no + 1, page_no FROM pg)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, page_no,
           row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS copy,
           (CASE WHEN page_no % 2 = 1 THEN 90 ELSE 0 END + CASE WHEN page_no = n_pages THEN 270 ELSE 0 END) % 360 AS degrees
    FROM o WHERE page_no <> 1""")
def pages_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last page first, then all; page 1 deleted; rotations add up."""
    return arrange.arrange(bridge.documents_with_pages(spark, sf_dir), "last,all", delete="1", rotate=[("odd", 90), ("last", -90)])


@query("pages_blank_after", f"""
    WITH {S_PAGES}, o AS (SELECT doc_id, page_no AS pos, 0 AS b, page_no FROM pg UNION ALL SELECT doc_id, 1, 1, NULL FROM docs)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, b) AS ord, coalesce(page_no, 0) AS page_no,
           CASE WHEN page_no IS NOT NULL THEN 1 ELSE 0 END AS copy, 0 AS degrees FROM o""")
def pages_blank_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank page has number 0."""
    return arrange.arrange(bridge.documents_with_pages(spark, sf_dir), blank_after=[1]).fillna(0, ["page_no", "copy"])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.documents_with_pages(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


S_FILES = S_DOCS + ", files AS (SELECT d.doc_id, source, n_pages FROM docs d JOIN documents USING (doc_id))"


@query("merge_offsets", f"""
    WITH {S_FILES} SELECT source, row_number() OVER w AS file_ord, doc_id, n_pages,
        1 + coalesce(sum(n_pages) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_page
    FROM files WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.merge_starts(_files(spark, sf_dir))


@query("merge_odd_starts", f"""
    WITH {S_FILES} SELECT source, row_number() OVER w AS file_ord, doc_id, n_pages,
        3 + coalesce(sum(n_pages + n_pages % 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_page
    FROM files WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def merge_odd_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.merge_starts(_files(spark, sf_dir), contents=True, odd=True)


@query("merge_contents", f"""
    WITH {S_FILES}, m AS (SELECT source, row_number() OVER w AS file_ord, doc_id,
        2 + coalesce(sum(n_pages) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_page
        FROM files WINDOW w AS (PARTITION BY source ORDER BY doc_id))
    SELECT *, (file_ord - 1) // 32 + 1 AS contents_page, (file_ord - 1) % 32 + 1 AS contents_row FROM m""")
def merge_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.contents_rows(_files(spark, sf_dir))


@query("nup_by_row", f"""WITH {S_PAGES} SELECT doc_id, page_no, (page_no - 1) // 6 + 1 AS sheet,
    ((page_no - 1) % 6) // 3 + 1 AS row, (page_no - 1) % 6 % 3 + 1 AS col FROM pg""")
def nup_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.nup(bridge.documents_with_pages(spark, sf_dir), 6, 3)


@query("nup_by_column", f"""WITH {S_PAGES} SELECT doc_id, page_no, (page_no - 1) // 6 + 1 AS sheet,
    (page_no - 1) % 6 % 2 + 1 AS row, ((page_no - 1) % 6) // 2 + 1 AS col FROM pg""")
def nup_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.nup(bridge.documents_with_pages(spark, sf_dir), 6, 3, by_column=True)


@query("booklet_order", f"""
    WITH {S_PAGES}, s AS (SELECT doc_id, n_pages, (n_pages + 3) // 4 * 4 AS p, unnest(range(0, (n_pages + 3) // 4)) AS s FROM docs),
    x AS (SELECT doc_id, n_pages, s + 1 AS sheet, 'front' AS side, 1 AS slot, p - 2 * s AS q FROM s
          UNION ALL SELECT doc_id, n_pages, s + 1, 'front', 2, 2 * s + 1 FROM s
          UNION ALL SELECT doc_id, n_pages, s + 1, 'back', 1, 2 * s + 2 FROM s
          UNION ALL SELECT doc_id, n_pages, s + 1, 'back', 2, p - 2 * s - 1 FROM s)
    SELECT doc_id, sheet, side, slot, CASE WHEN q <= n_pages THEN q ELSE 0 END AS page_no FROM x""")
def booklet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank places have page 0."""
    return arrange.booklet(bridge.documents_with_pages(spark, sf_dir)).fillna(0, ["page_no"])


@query("bates_labels", f"""WITH {S_PAGES} SELECT doc_id, page_no, 'bottom-right' AS position,
    'AB-' || lpad((998 + page_no)::VARCHAR, greatest(3, len((998 + page_no)::VARCHAR))::INTEGER, '0') || '-X' AS label FROM pg""")
def bates_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.number_pages(bridge.documents_with_pages(spark, sf_dir), {"bottom-right": "{bates}"}, bates=("AB-", 999, 3, "-X"))


@query("header_footer_labels", f"""
    WITH {S_PAGES} SELECT doc_id, page_no, 'top-left' AS position, 'doc' || doc_id || ' 2026-01-01' AS label FROM pg
    UNION ALL SELECT doc_id, page_no, 'bottom-center', page_no || ' of ' || n_pages FROM pg""")
def header_footer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.number_pages(bridge.documents_with_pages(spark, sf_dir), {"top-left": "{file} {date}", "top-right": " ", "bottom-center": "{n} of {total}"})


@query("skip_first_labels", f"""
    WITH {S_PAGES}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n
        FROM pg WHERE page_no % 2 = 1)
    SELECT doc_id, page_no, 'bottom-center' AS position, (k + 4) || '/' || (n + 4) AS label FROM c WHERE k > 1""")
def skip_first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrange.number_pages(bridge.documents_with_pages(spark, sf_dir), {"bottom-center": "{n}/{total}"}, spec="odd", start=5, skip_first=True)


@query("search_ignoring_case", f"""
    WITH {S_LINES} SELECT doc_id, page_no, line_no, len(regexp_extract_all(text, '(?i)the a')) AS n_hits FROM lines WHERE regexp_matches(text, '(?i)the a')""")
def search_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.size(text.occurrences(F.col("text"), "the  a"))
    return bridge.lines(spark, sf_dir).where(text.contains(F.col("text"), "the a")).select("doc_id", "page_no", "line_no", hits.alias("n_hits"))


@query("search_whole_words", f"""
    WITH {S_LINES}, s AS (SELECT *, len(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w = 'was')) AS n_hits FROM lines)
    SELECT doc_id, page_no, line_no, n_hits FROM s WHERE n_hits > 0""")
def search_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.size(text.occurrences(F.col("text"), "was", whole_words=True))
    return bridge.lines(spark, sf_dir).select("doc_id", "page_no", "line_no", hits.alias("n_hits")).where("n_hits > 0")


@query("search_hits_by_page", f"""
    WITH {S_LINES} SELECT doc_id, page_no, sum(len(regexp_extract_all(text, 'ing')))::BIGINT AS n_hits FROM lines
    WHERE contains(text, 'ing') GROUP BY ALL""")
def search_hits_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.lines(spark, sf_dir).where(F.contains("text", F.lit("ing")))
    return rows.groupBy("doc_id", "page_no").agg(F.sum(F.size(text.occurrences(F.col("text"), "ing", match_case=True))).alias("n_hits"))


@query("pages_without_text", f"""
    WITH {S_LINES}, f AS (SELECT doc_id, page_no, bool_or(trim(CASE WHEN (doc_id + page_no) % 3 = 0 THEN ' ' ELSE text END) <> '') AS t FROM lines GROUP BY ALL)
    SELECT doc_id, page_no FROM f WHERE NOT t""")
def pages_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without words, where every third page is a scan that has none."""
    words = F.when((F.col("doc_id") + F.col("page_no")) % 3 == 0, " ").otherwise(F.col("text"))
    return bridge.lines(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.bool_or(F.trim(words) != "").alias("t")).where("not t").select("doc_id", "page_no")


@query("compare_presence", f"""
    WITH {S_NEW}, a AS (SELECT doc_id, page_no, list(text ORDER BY line_no) AS t FROM lines GROUP BY ALL),
    b AS (SELECT doc_id, page_no, list(text ORDER BY line_no) AS t FROM newer GROUP BY ALL)
    SELECT doc_id, page_no, CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'both' END AS presence,
           a.t IS DISTINCT FROM b.t AS text_changed FROM a FULL JOIN b USING (doc_id, page_no)""")
def compare_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = bridge.lines(spark, sf_dir)
    return compare.presence(old, bridge.new_version(old))


@query("compare_line_diff")
def compare_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = bridge.lines(spark, sf_dir)
    return compare.line_diff(old, bridge.new_version(old))


@query("compare_summary", f"""
    WITH {S_NEW},
    gone AS (SELECT * FROM lines EXCEPT SELECT * FROM newer), come AS (SELECT * FROM newer EXCEPT SELECT * FROM lines),
    c AS (SELECT doc_id, page_no, 1 AS removed, 0 AS added FROM gone UNION ALL SELECT doc_id, page_no, 0, 1 FROM come)
    SELECT d.doc_id, coalesce(array_to_string(list_sort(list(DISTINCT page_no) FILTER (WHERE page_no IS NOT NULL)), ','), '') AS changed_pages,
           coalesce(sum(removed), 0)::BIGINT AS removed_lines, coalesce(sum(added), 0)::BIGINT AS added_lines, count(page_no) = 0 AS identical
    FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = bridge.lines(spark, sf_dir)
    return compare.summary(old, bridge.new_version(old))


@query("strip_report", """
    SELECT (count(*) FILTER (WHERE event_type = 'click'))::BIGINT AS n_click, (count(*) FILTER (WHERE event_type = 'view'))::BIGINT AS n_view,
           (count(*) FILTER (WHERE event_type = 'purchase'))::BIGINT AS n_purchase, count(DISTINCT user_id) AS n_names FROM events""")
def strip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.strip_report(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"], "user_id")


@query("upper_median", """
    SELECT l_partkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_partkey""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(text.upper_median(F.collect_list("l_quantity")).alias("upper_median"))


S_WORDS = """
    w AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, p_partkey, p_name, p_size FROM part),
    words AS (SELECT p_brand AS page, p_partkey::VARCHAR AS text, 36.0::DOUBLE AS x0, r FROM w
              UNION ALL SELECT p_brand, string_split(p_name, ' ')[1], 120.0, r FROM w
              UNION ALL SELECT p_brand, p_size::VARCHAR, 260.0, r FROM w),
    boxes AS (SELECT page, text, x0, r * 14.0::DOUBLE AS y0, x0 + len(text) * 5.0::DOUBLE AS x1, r * 14.0::DOUBLE + 10.7::DOUBLE AS y1 FROM words)"""


@query("bounding_box", f"WITH {S_WORDS} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bounding_box(bridge.positioned_words(spark, sf_dir), "page")


@query("uniform_crop", f"""WITH {S_WORDS}, b AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page),
    u AS (SELECT min(x0) AS cx0, min(y0) AS cy0, max(x1) AS cx1, max(y1) AS cy1 FROM b)
    SELECT page, (cx1 - cx0) - (x1 - x0) AS spare_width, (cy1 - cy0) - (y1 - y0) AS spare_height FROM b, u""")
def uniform_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for all pages; the one-row aggregate is broadcast."""
    b = report.bounding_box(bridge.positioned_words(spark, sf_dir), "page")
    u = b.agg(F.min("x0").alias("cx0"), F.min("y0").alias("cy0"), F.max("x1").alias("cx1"), F.max("y1").alias("cy1"))
    return b.join(F.broadcast(u)).select(
        "page", ((F.col("cx1") - F.col("cx0")) - (F.col("x1") - F.col("x0"))).alias("spare_width"), ((F.col("cy1") - F.col("cy0")) - (F.col("y1") - F.col("y0"))).alias("spare_height")
    )


@query("tables_detect", f"""
    WITH b AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_partkey, p_name, p_size FROM part),
    w AS (SELECT p_brand || '/' || (k // 50) AS page, k % 50 + 1 AS r, count(*) OVER (PARTITION BY p_brand, k // 50) AS n, p_partkey, p_name, p_size FROM b)
    SELECT page, 1 AS table_no, r AS row_no, c AS col_no,
           CASE c WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN string_split(p_name, ' ')[1] ELSE p_size::VARCHAR END AS text
    FROM w, range(1, 4) t(c) WHERE n >= 2""")
def tables_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells found from positions alone; they equal the rows that were printed."""
    return tables.detect(bridge.positioned_words(spark, sf_dir, 50))


@query("dedup_remap", """
    SELECT s.l_orderkey * 10 + s.l_linenumber AS id, min(s.l_orderkey * 10 + s.l_linenumber) OVER (PARTITION BY l_quantity, l_discount, l_tax, l_shipdate) AS keep_id FROM lineitem s""")
def dedup_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return graph.first_copies(rows, "id", ["l_quantity", "l_discount", "l_tax", "l_shipdate"])


@query("reachable_objects", """
    WITH RECURSIVE refs AS (
        SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    r AS (SELECT 'o' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderpriority = '1-URGENT'
          UNION SELECT dst, depth + 1 FROM r JOIN refs ON src = node)
    SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.reachable(bridge.refs(spark, sf_dir), roots)


@query("inherited_attribute", """
    SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'own' END, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, r_name) AS value
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def inherited_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest value up the tree: own, the nation's, the region's."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    up = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return up.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") < 0, "own"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), "r_name").alias("value"))


@query("keep_last_object", """
    SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def keep_last_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return graph.keep_last(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("newest_valid_root", """
    SELECT user_id, arg_max(event_id, (CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, event_id)) AS event_id FROM events GROUP BY user_id""")
def newest_valid_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row that is valid, else the newest."""
    order = F.struct((F.col("event_type") == "purchase").cast("int"), F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", order).alias("event_id"))


@query("number_runs", """
    WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), g AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM d)
    SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last FROM g GROUP BY l_suppkey, g""")
def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.islands(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


def _csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_brand, data): a semicolon-separated file per brand."""
    fields = [text.csv_field(F.col(c).cast("string"), ";") for c in ("p_partkey", "p_name", "p_type", "p_size")]
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(";", *fields).alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", "line")))
    return rows.groupBy("p_brand").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\r\n").alias("data"))


@query("csv_sniff", "SELECT DISTINCT p_brand, ';' AS delimiter FROM part")
def csv_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    sniff = F.pandas_udf(lambda s: s.map(csvtext.sniff), "string")
    return _csv_files(spark, sf_dir).select("p_brand", sniff("data").alias("delimiter"))


@query("csv_parse", """
    SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no, p_partkey::VARCHAR AS c1, p_name AS c2, p_type AS c3, p_size::VARCHAR AS c4 FROM part""")
def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parse = F.pandas_udf(lambda s: s.map(lambda t: csvtext.parse(t, ";")), "array<array<string>>")
    rows = _csv_files(spark, sf_dir).select("p_brand", F.posexplode(parse("data")).alias("pos", "row"))
    return rows.select("p_brand", (F.col("pos") + 1).alias("row_no"), *(F.get("row", F.lit(i)).alias(f"c{i + 1}") for i in range(4)))


@query("csv_numeric_columns", """
    WITH c AS (SELECT p_brand, unnest(['p_partkey', 'p_name', 'p_size', 'p_retailprice']) AS col, unnest([p_partkey::VARCHAR, p_name, p_size::VARCHAR, '$' || p_size || '.50']) AS cell FROM part)
    SELECT p_brand, col, bool_and(regexp_matches(cell, '^[$]?[0-9][0-9,.]*$')) FILTER (WHERE cell <> '') AND count(*) FILTER (WHERE cell <> '') > 0 AS numeric FROM c GROUP BY ALL""")
def csv_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {"p_partkey": F.col("p_partkey").cast("string"), "p_name": F.col("p_name"), "p_size": F.col("p_size").cast("string"), "p_retailprice": F.concat(F.lit("$"), "p_size", F.lit(".50"))}
    each = F.array(*(F.struct(F.lit(k).alias("col"), v.alias("cell")) for k, v in cells.items()))
    rows = table(spark, sf_dir, "part").select("p_brand", F.explode(each).alias("x")).select("p_brand", "x.*").withColumn("cell", F.trim("cell"))
    full = F.col("cell") != ""
    return rows.groupBy("p_brand", "col").agg((F.bool_and(F.when(full, text.is_number(F.col("cell")))) & (F.count_if(full) > 0)).alias("numeric"))


@query("csv_page_fill", """
    WITH RECURSIVE r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_no, 10.0 + p_size % 5 * 12 AS h FROM part),
    f AS (SELECT p_brand, row_no, 1 AS page, 20.0 + h AS used FROM r WHERE row_no = 1
          UNION ALL SELECT r.p_brand, r.row_no, CASE WHEN f.used + r.h > 300 AND f.used > 20 THEN page + 1 ELSE page END,
                           CASE WHEN f.used + r.h > 300 AND f.used > 20 THEN 20 + r.h ELSE f.used + r.h END
          FROM f JOIN r ON r.p_brand = f.p_brand AND r.row_no = f.row_no + 1)
    SELECT p_brand, row_no, page FROM f""")
def csv_page_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "part").select(
        "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("row_no"), (10.0 + F.col("p_size") % 5 * 12).alias("h")
    )
    return report.fill_pages(rows, "p_brand", "row_no", "h", 300.0, 20.0)


@query("wrap_text")
def wrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents set to 60 characters, one row per part of a line."""
    wrap = F.pandas_udf(lambda s: s.map(lambda t: csvtext.wrap(t, 60)), "array<string>")
    rows = bridge.lines(spark, sf_dir)
    return rows.select("doc_id", "line_no", F.posexplode(wrap("text")).alias("pos", "line")).select("doc_id", "line_no", (F.col("pos") + 1).alias("part"), "line")


@query("html_remote_refs", """
    SELECT page_id, regexp_matches(lower(html), 'src=["'']?http|src=["'']//|url\\(["'']?http|url\\(//|@import ["'']http|rel="stylesheet" href="http') AS remote FROM pages""")
def html_remote_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", htmltext.refers_to_remote(F.col("html")).alias("remote"))


@query("html_inject", """
    SELECT page_id, sha256(replace(replace(html, '<head>', '<head><base href="file:///x/">'), '</head>', '<style>p{}</style></head>')) AS html_sha256 FROM pages""")
def html_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.inject(F.col("html"), "file:///x/", "p{}")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(out, 256).alias("html_sha256"))


@query("url_stem", """
    WITH a AS (SELECT page_id, left(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[^A-Za-z0-9.\\-]', '-', 'g'), 60) AS s FROM pages)
    SELECT page_id, CASE WHEN regexp_replace(s, '^-+|-+$', '', 'g') = '' THEN 'page' ELSE regexp_replace(s, '^-+|-+$', '', 'g') END AS stem FROM a""")
def url_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_stem(F.col("url")).alias("stem"))


@query("percent_codec", """
    SELECT page_id, replace(replace(url_encode(url), '%2F', '/'), '%3A', ':') AS encoded, url AS decoded FROM pages""")
def percent_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = text.percent_encode(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", coded.alias("encoded"), text.percent_decode(coded).alias("decoded"))


@query("pdf_date_iso", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS iso FROM orders""")
def pdf_date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+02'00'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_of_pdf(stamp).alias("iso"))


@query("fuzzy_rank")
def fuzzy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best names for each query; distinct names are scored once."""
    from pyspark.sql.window import Window

    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    score = F.pandas_udf(lambda q, t: pd.Series([fuzzy.score(a, b) for a, b in zip(q, t, strict=True)], dtype="Int64"), "long")
    each = names.withColumn("query", F.explode(F.array(F.lit("rg"), F.lit("bolt"), F.lit("s wi"))))
    scored = each.withColumn("score", score("query", "p_name")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "p_partkey"))
    return scored.withColumn("rank", rank).where("rank <= 6").select("query", "rank", "p_name", "score")


@query("estimate_sampled", """
    WITH n AS (SELECT l_suppkey, l_quantity, l_quantity * (1 - l_discount) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) AS rn FROM lineitem),
    s AS (SELECT *, (rn - 1) % ceil(n / 12)::BIGINT = 0 AS taken FROM n)
    SELECT l_suppkey, sum(l_quantity) AS total, count(*) FILTER (WHERE taken) AS sampled,
           round(least(sum(l_quantity), sum(l_quantity) * sum(r) FILTER (WHERE taken) / sum(l_quantity) FILTER (WHERE taken)), 3) AS estimate FROM s GROUP BY l_suppkey""")
def estimate_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_quantity") * (1 - F.col("l_discount")))
    return report.sampled_ratio(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"], "l_quantity", "r").withColumn("estimate", F.round("estimate", 3))


@query("permission_bits", """
    SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END) | (CASE WHEN p_size % 3 = 0 THEN 16 ELSE 0 END) | (CASE WHEN p_size % 5 = 0 THEN 2048 ELSE 0 END) AS bits FROM part""")
def permission_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", report.permission_bits({"print": s % 2 == 0, "copy": s % 3 == 0, "print_fine": s % 5 == 0}).alias("bits"))


@query("queue_summary", """
    SELECT source, count(*) AS files, sum((len(string_split(text, chr(10))) + 9) // 10)::BIGINT AS pages, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY source""")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("b"), F.ceil(F.size(F.split("text", "\n")) / 10).alias("p"))
    return d.groupBy("source").agg(F.count("*").alias("files"), F.sum("p").alias("pages"), F.sum("b").cast("long").alias("bytes"))


@query("ocr_tsv_words", """
    SELECT l_orderkey, l_linenumber, l_returnflag AS text, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY b) AS line
    FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_linestatus) AS b FROM lineitem WHERE l_quantity >= 10)""")
def ocr_tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of recogniser output (tab-separated text), lines numbered as they first appear."""
    from pyspark.sql.window import Window

    item = table(spark, sf_dir, "lineitem")
    tsv = item.select(F.concat_ws("\t", F.lit("5"), "l_orderkey", "l_linestatus", "l_linenumber", F.when(F.col("l_quantity") >= 10, "90").otherwise("-1"), "l_returnflag").alias("row"))
    f = F.split("row", "\t")
    words = tsv.select(*(F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("level", "page", "block", "no", "conf", "text"))))
    words = words.where("level = '5' and cast(conf as double) >= 0 and trim(text) != ''").select(F.col("page").cast("long").alias("l_orderkey"), "block", F.col("no").cast("int").alias("l_linenumber"), "text")
    seen = words.withColumn("b", F.min("l_linenumber").over(Window.partitionBy("l_orderkey", "block")))
    line = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("b"))
    return seen.select("l_orderkey", "l_linenumber", "text", line.alias("line"))


@query("format_values", """
    SELECT p_partkey, rtrim(rtrim(printf('%.4f', p_retailprice), '0'), '.') AS number, p_size || CASE WHEN p_size = 1 THEN ' page' ELSE ' pages' END AS pages FROM part""")
def format_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.number_text(F.col("p_retailprice")).alias("number"), text.plural(F.col("p_size"), "page", "pages").alias("pages"))


@query("paper_sizes", """
    SELECT p_partkey, (p_size + 100) * (72 / 25.4::DOUBLE) AS w, (p_size + 150) * (72 / 25.4::DOUBLE) AS h FROM part""")
def paper_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = geometry.paper(F.concat((F.col("p_size") + 100).cast("string"), F.lit(" x "), (F.col("p_size") + 150).cast("string"), F.lit("mm")))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.w", "s.h")


S_GRID = """
    a AS (SELECT p_brand AS page, p_partkey AS id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 53 % 700)::DOUBLE AS y0,
                 (p_partkey * 37 % 500 + 10 + p_size)::DOUBLE AS x1, (p_partkey * 53 % 700 + 12)::DOUBLE AS y1, p_size FROM part)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_partkey") * 37 % 500, F.col("p_partkey") * 53 % 700
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), "p_size", geometry.rect(x, y, x + 10 + F.col("p_size"), y + 12).alias("r")
    )


@query("spatial_overlaps", f"""
    WITH {S_GRID} SELECT a.page, a.id AS a_id, b.id AS b_id FROM a JOIN a b ON a.page = b.page AND a.p_size <= 25 AND b.p_size > 25
        AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def spatial_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of two kinds that overlap on a page."""
    r = _grid(spark, sf_dir)
    return fields.overlaps(r.where("p_size <= 25"), r.where("p_size > 25"))


@query("padded_marks", f"""
    WITH {S_GRID}, p AS (SELECT id, greatest(x0 - 5, 0) AS x0, greatest(y0 - 5, 0) AS y0, least(x1 + 5, 400) AS x1, least(y1 + 5, 600) AS y1 FROM a)
    SELECT id, x0, y0, x1, y1 FROM p WHERE x1 - x0 > 0.01 AND y1 - y0 > 0.01""")
def padded_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks grown and cut to the page; what falls off the page is dropped."""
    r = geometry.clamp(geometry.grow(F.col("r"), 5.0), 400.0, 600.0)
    return _grid(spark, sf_dir).select("id", r.alias("r")).where("r is not null").select("id", "r.*")


@query("field_fill", """
    WITH f AS (SELECT c_custkey AS doc_id, 'phone' AS name, 'text' AS kind, c_name AS value FROM customer
               UNION ALL SELECT c_custkey, 'agree', 'checkbox', 'Off' FROM customer),
    v AS (SELECT c_custkey AS doc_id, 'phone' AS name, 'n' || c_nationkey AS value FROM customer WHERE c_acctbal >= 0
          UNION ALL SELECT c_custkey, 'agree', CASE WHEN c_custkey % 2 = 0 THEN ' Yes ' ELSE 'no' END FROM customer
          UNION ALL SELECT c_custkey, 'missing', 'x' FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT doc_id, name, coalesce(kind, '-') AS kind,
           CASE WHEN v.value IS NULL THEN f.value WHEN kind = 'checkbox' THEN CASE WHEN trim(lower(v.value)) = 'yes' THEN 'On' ELSE 'Off' END ELSE v.value END AS value,
           CASE WHEN kind IS NULL THEN 'unknown' WHEN v.value IS NULL THEN 'kept' ELSE 'filled' END AS outcome
    FROM f FULL JOIN v USING (doc_id, name)""")
def field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("doc_id", F.col("c_custkey"))
    own = c.select("doc_id", F.lit("phone").alias("name"), F.lit("text").alias("kind"), F.col("c_name").alias("value")).union(
        c.select("doc_id", F.lit("agree"), F.lit("checkbox"), F.lit("Off"))
    )
    given = (
        c.where("c_acctbal >= 0").select("doc_id", F.lit("phone").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("value"))
        .union(c.select("doc_id", F.lit("agree"), F.when(F.col("doc_id") % 2 == 0, " Yes ").otherwise("no")))
        .union(c.where("c_mktsegment = 'BUILDING'").select("doc_id", F.lit("missing"), F.lit("x")))
    )
    return fields.fill(own, given).fillna("-", ["kind"])


@query("choice_options", """
    WITH o AS (SELECT n_regionkey AS field, n_nationkey AS idx, 'N' || n_nationkey AS export, n_name AS display FROM nation),
    v AS (SELECT c_custkey, n_regionkey AS field, CASE WHEN c_custkey % 2 = 0 THEN 'N' || n_nationkey ELSE n_name END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, v.field, value, (SELECT arg_min(export, idx) FROM o WHERE o.field = v.field AND (o.export = v.value OR o.display = v.value)) AS export FROM v""")
def choice_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    options = n.select(F.col("n_regionkey").alias("field"), F.col("n_nationkey").alias("idx"), F.concat(F.lit("N"), "n_nationkey").alias("export"), F.col("n_name").alias("display"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("N"), "n_nationkey")).otherwise(F.col("n_name"))
    return fields.choose(c.select("c_custkey", F.col("n_regionkey").alias("field"), value.alias("value")), options)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, ord, label, value): regions, their nations and their customers."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("label"), F.concat(F.lit("v"), "r_regionkey").alias("value"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey").cast("long"), "n_name", F.when(F.col("n_nationkey") % 4 == 0, "own"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_custkey", "c_name", F.lit(None).cast("string"))
    return r.union(n).union(c)


@query("tree_walk", """
    SELECT 'r' || r_regionkey AS node, 0 AS depth, r_name AS path, 'v' || r_regionkey AS value FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '.' || n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE 'v' || r_regionkey END FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'c' || c_custkey, 2, r_name || '.' || n_name || '.' || c_name, CASE WHEN n_nationkey % 4 = 0 THEN 'own' ELSE 'v' || r_regionkey END
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names and inherited values, level by level."""
    return fields.walk(_tree(spark, sf_dir))


@query("bookmarks_kept", """
    WITH a AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0)
    SELECT DISTINCT node FROM (SELECT 'c' || c_custkey AS node FROM a UNION SELECT 'n' || n_nationkey FROM a UNION SELECT 'r' || n_regionkey FROM a)""")
def bookmarks_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return fields.keep_with_descendants(_tree(spark, sf_dir), alive)


@query("outline_links", """
    WITH t AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS ord FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation),
    k AS (SELECT parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY parent)
    SELECT t.node, coalesce(lag(t.node) OVER w, '') AS prev, coalesce(lead(t.node) OVER w, '') AS next, coalesce(n, 0) AS n_children
    FROM t LEFT JOIN k ON k.parent = t.node WINDOW w AS (PARTITION BY t.parent ORDER BY ord)""")
def outline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.siblings(_tree(spark, sf_dir).where("node not like 'c%'")).fillna("", ["prev", "next"])


@query("rename_clashes", """
    WITH n AS (SELECT c_custkey AS file_ord, c_mktsegment || CASE WHEN c_custkey % 7 = 0 THEN '_2' ELSE '' END AS name FROM customer),
    k AS (SELECT file_ord, name, row_number() OVER (PARTITION BY name ORDER BY file_ord) AS k FROM n)
    SELECT file_ord, name, CASE WHEN k = 1 THEN name WHEN ends_with(name, '_2') THEN name || '_' || k ELSE name || '_' || (k + 1) END AS new_name FROM k""")
def rename_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that repeat, beside names that already look renumbered."""
    name = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "_2").otherwise(""))
    return fields.rename_clashes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_ord"), name.alias("name")))


@query("glyph_words", """
    WITH w AS (SELECT item_id::VARCHAR AS page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM benchmark)
    SELECT page, unnest(range(1, len(ws) + 1)) AS word_no, unnest(ws) AS text FROM w""")
def glyph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words grouped from glyphs at fixed steps equal the words that were set."""
    chars = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.regexp_replace("text", r"\s", " "), "")).alias("ord", "ch")).where("ch != ''")
    glyphs = chars.select(
        F.col("item_id").cast("string").alias("page"), "ord", "ch", (F.col("ord") * 5.0).alias("x0"), (F.col("ord") * 5.0 + 5).alias("x1"), F.lit(20.0).alias("y"), F.lit(10.0).alias("size"), F.lit(0.0).alias("angle")
    )
    return layout.group_glyphs(glyphs).select("page", "word_no", "text")


S_PARA = """
    l AS (SELECT p_brand AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line_no, p_name AS text,
                 (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) * 14.0 - CASE WHEN p_size % 4 = 0 THEN 12 ELSE 0 END AS y, 8.0 + p_size % 7 AS size FROM part)"""


@query("paragraphs", f"""
    WITH {S_PARA}, m AS (SELECT page, list_sort(list(size))[count(*) // 2 + 1] AS median FROM l GROUP BY page)
    SELECT page, line_no, text, coalesce(abs(y - lag(y) OVER (PARTITION BY page ORDER BY line_no)) < 0.4 * size, false) AS joins, size > 1.25 * median AS heading FROM l JOIN m USING (page)""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    no = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), no.alias("line_no"), F.col("p_name").alias("text"), "p_size")
    return layout.paragraphs(
        rows.select("page", "line_no", "text", (F.col("line_no") * 14.0 - F.when(F.col("p_size") % 4 == 0, 12).otherwise(0)).alias("y"), (F.col("p_size") % 7 + 8.0).alias("size"))
    )


@query("stream_window_counts", """
    SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the events as a stream, hourly counts after all input has been read."""
    from quire.plans import scratch
    from quire.streaming import search

    events = table(spark, sf_dir, "events")
    out = scratch.new_path(spark, "stream")
    counts = search.counts_by_window(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"))
    batch = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch.new_path(spark, "offsets"))
    batch.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
