"""Named queries over document objects, with their SQL: annotations, outlines, references, layouts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import objects
from quire.plans.library import S_LINES, S_PAGES, marks
from quire.plans.registry import query
from quire.sources import bridge
from quire.sources.bridge import table

S_ANNOTS = """
    annots AS (SELECT event_id AS id, user_id, CASE event_type WHEN 'click' THEN 'Widget' WHEN 'view' THEN 'Popup' WHEN 'signup' THEN 'Link' ELSE 'Text' END AS subtype,
                      event_id - 1 AS parent, value < 5 AS invisible, event_type = 'click' AS drawable FROM events)"""


def annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotations; a pop-up belongs to the event before it."""
    kind = F.col("event_type")
    subtype = F.when(kind == "click", "Widget").when(kind == "view", "Popup").when(kind == "signup", "Link").otherwise("Text")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", subtype.alias("subtype"), (F.col("event_id") - 1).alias("parent"), (F.col("value") < 5).alias("invisible"), (kind == "click").alias("drawable")
    )


@query("flatten_fate", f"""
    WITH {S_ANNOTS}, f AS (SELECT id, parent, CASE WHEN subtype = 'Popup' THEN NULL WHEN invisible THEN 'drop' WHEN drawable THEN 'draw' ELSE 'keep' END AS own FROM annots)
    SELECT f.id, coalesce(f.own, CASE WHEN p.own = 'keep' THEN 'keep' ELSE 'drop' END) AS fate FROM f LEFT JOIN f p ON p.id = f.parent""")
def flatten_fate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.fates(annots(spark, sf_dir))


@query("annotation_summary", f"""
    WITH {S_ANNOTS} SELECT user_id, count(*) FILTER (WHERE subtype = 'Link') AS links, count(*) FILTER (WHERE subtype = 'Text') AS annotations FROM annots GROUP BY user_id""")
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.annotation_summary(annots(spark, sf_dir), "user_id")


S_OUTLINE = """
    outline AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey % 2 = 0 AS open FROM region
                UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey % 3 <> 0 FROM nation
                UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, true FROM customer)"""


@query("outline_counts", f"""
    WITH RECURSIVE {S_OUTLINE},
    s AS (SELECT parent AS top, node AS down, open FROM outline WHERE parent IS NOT NULL
          UNION ALL SELECT s.top, o.node, o.open FROM s JOIN outline o ON o.parent = s.down WHERE s.open)
    SELECT node, CASE WHEN any_value(o.open) THEN count(*) ELSE -count(*) END AS n_visible FROM s JOIN outline o ON o.node = s.top GROUP BY node""")
def outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items below each bookmark that are shown when it is open; negative where it is closed."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") % 2 == 0).alias("open"))
    nodes = nodes.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey") % 3 != 0))
    return objects.visible_counts(nodes.union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit(True))))


@query("bookmark_states", """
    WITH named AS (SELECT 'd' || p_size AS name, min(p_partkey) AS page FROM part WHERE p_size % 4 <> 0 GROUP BY ALL),
    later AS (SELECT 'd' || l_linenumber AS name, min(l_partkey) AS page FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL),
    known AS (SELECT coalesce(l.name, n.name) AS name, coalesce(l.page, n.page) AS page FROM named n FULL JOIN later l ON l.name = n.name)
    SELECT o_orderkey AS id, k.page, CASE WHEN k.page IS NULL THEN 'unknown' WHEN p.p_partkey IS NOT NULL THEN 'live' ELSE 'dead' END AS state
    FROM orders LEFT JOIN known k ON k.name = 'd' || (o_orderkey % 60) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) p ON p.p_partkey = k.page""")
def bookmark_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks by named destinations of two tables, of which the later one wins."""
    part, item = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    first = part.where("p_size % 4 != 0").groupBy(F.concat(F.lit("d"), "p_size").alias("name")).agg(F.min("p_partkey").alias("page"))
    second = item.where("l_linenumber > 3").groupBy(F.concat(F.lit("d"), "l_linenumber").alias("name")).agg(F.min("l_partkey").alias("page"))
    marks_ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("d"), F.col("o_orderkey") % 60).alias("name"))
    return objects.bookmark_states(marks_, first, second, part.where("p_size < 45").select(F.col("p_partkey").alias("page")))


@query("number_gaps", """
    WITH u AS (SELECT o_custkey, list(DISTINCT o_orderkey % 40 + 1) AS used FROM orders GROUP BY o_custkey),
    a AS (SELECT o_custkey, used, unnest(range(1, list_max(used) + 1)) AS num FROM u)
    SELECT o_custkey, num FROM a WHERE NOT list_contains(used, num)""")
def number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object numbers from 1 on that a document leaves out."""
    used = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40 + 1).alias("num"))
    return objects.gaps(used, "o_custkey", "num")


@query("image_use", """
    SELECT p_partkey AS image, max(l_quantity) AS width, max(l_extendedprice) AS height, min(l_orderkey) AS first_page, min(l_orderkey) IS NOT NULL AS used
    FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 46) ON l_partkey = p_partkey GROUP BY p_partkey""")
def image_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").where("l_quantity > 46")
    uses = uses.select(F.col("l_partkey").alias("image"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("h"), F.col("l_orderkey").alias("page"))
    return objects.image_use(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image")), uses)


@query("tree_outcome", """
    WITH there AS (SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'c' || c_custkey FROM customer),
    e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
    seen AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_regionkey > 0
             UNION SELECT dst FROM e WHERE src IN (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey > 0)
             UNION SELECT b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src IN (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey > 0) AND a.dst IN (SELECT node FROM there))
    SELECT count(*) FILTER (WHERE t.node IS NOT NULL AND s.node IS NOT NULL) AS kept, count(*) FILTER (WHERE t.node IS NULL) AS lost, count(*) FILTER (WHERE s.node IS NULL) AS orphans
    FROM there t FULL JOIN seen s ON s.node = t.node""")
def tree_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree without every fifth nation, and one region that no root names."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    region, nation, customer = F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("c"), "c_custkey")
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), nation.alias("dst")).union(c.select(F.concat(F.lit("n"), "c_nationkey"), customer))
    present = r.select(region.alias("node")).union(n.where("n_nationkey % 5 != 0").select(nation)).union(c.select(customer))
    return objects.tree_outcome(edges, present, r.where("r_regionkey > 0").select(region.alias("node")))


@query("recent_items", """
    WITH l AS (SELECT user_id, floor(value)::BIGINT AS item, max((ts, event_id)) AS latest FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC) AS rank FROM l)
    SELECT user_id, rank, item FROM k WHERE rank <= 5""")
def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's five latest items, each once (a top-k report)."""
    return objects.recent(table(spark, sf_dir, "events").withColumn("item", F.floor("value")), "user_id", "item", ["ts", "event_id"])


@query("csv_column_widths", """
    WITH cells AS (SELECT p_brand, unnest([1, 2, 3]) AS col, unnest([p_name, p_type, p_partkey::VARCHAR]) AS text FROM part),
    b AS (SELECT p_brand, col, max(len(text)) * 5.0 AS line, max(list_max(list_transform(string_split_regex(text, '\\s+'), lambda w: len(w)))) * 5.0 AS word FROM cells GROUP BY ALL),
    e AS (SELECT p_brand, col, line + 8 AS wish0, least(greatest(least(word, 130.0 / 3), 20) + 8, greatest(line + 8, 28)) AS need FROM b),
    f AS (SELECT p_brand, col, greatest(wish0, need) AS wish, need, sum(greatest(wish0, need)) OVER w AS aw, sum(need) OVER w AS an FROM e WINDOW w AS (PARTITION BY p_brand))
    SELECT p_brand, col, round(CASE WHEN aw <= 130 THEN wish WHEN an >= 130 THEN need * 130 / an ELSE need + (wish - need) / (aw - an) * (130 - an) END, 4)::DOUBLE AS width FROM f""")
def csv_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of the columns of printed lists that share 130 points."""
    own = F.array(F.col("p_name"), F.col("p_type"), F.col("p_partkey").cast("string"))
    cells = table(spark, sf_dir, "part").select("p_brand", F.posexplode(own).alias("pos", "text")).select("p_brand", (F.col("pos") + 1).alias("col"), "text")
    return objects.column_widths(cells, "p_brand", 130.0).withColumn("width", F.round("width", 4))


@query("nup_best_layout", """
    WITH s AS (SELECT 200.0 + p_size * 10 AS w, 700.0 - p_size * 5 AS h FROM part),
    l AS (SELECT * FROM (VALUES (1, 297.0, 421.0), (2, 421.0, 297.0), (3, 198.0, 842.0)) t(layout, cw, ch))
    SELECT layout, round(sum(least(cw / greatest(w, 1), ch / greatest(h, 1)) ** 2 * w * h), 3)::DOUBLE AS coverage FROM s, l GROUP BY layout ORDER BY coverage DESC, layout LIMIT 1""")
def nup_best_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three layouts the one whose pages cover most paper."""
    sizes = table(spark, sf_dir, "part").select((200.0 + F.col("p_size") * 10).alias("w"), (700.0 - F.col("p_size") * 5).alias("h"))
    return objects.best_layout(sizes, [(1, 297.0, 421.0), (2, 421.0, 297.0), (3, 198.0, 842.0)]).withColumn("coverage", F.round("coverage", 3))


@query("watermark_centres", """
    WITH p AS (SELECT DISTINCT p_size AS page, 300.0::DOUBLE + p_size * 7 AS w, 400.0::DOUBLE + p_size * 3 AS h, 90.0::DOUBLE AS bw, 20.0::DOUBLE + p_size AS bh FROM part),
    c AS (SELECT *, cos(radians(40)) AS co, sin(radians(40)) AS si FROM p),
    z AS (SELECT *, (bw * abs(co) + bh * abs(si)) / 2 AS hw, (bw * abs(si) + bh * abs(co)) / 2 AS hh, greatest(bw * 1.3 + 0.04 * w, 12) AS sx, greatest(bh * 2.2 + 0.07 * h, 12) AS sy, sqrt(w * w + h * h) / 2 AS reach FROM c),
    r AS (SELECT *, unnest(range(-(ceil(reach / sy)::BIGINT + 1), ceil(reach / sy)::BIGINT + 2)) AS row_no FROM z),
    g AS (SELECT *, unnest(range(-(ceil(reach / sx)::BIGINT + 1), ceil(reach / sx)::BIGINT + 2)) AS col_no FROM r),
    u AS (SELECT *, col_no * sx + CASE WHEN row_no % 2 <> 0 THEN sx / 2 ELSE 0 END AS al, row_no * sy AS ac FROM g),
    x AS (SELECT *, w / 2 + al * co - ac * si AS x, h / 2 + al * si + ac * co AS y FROM u)
    SELECT page, row_no::INTEGER AS row_no, col_no::INTEGER AS col_no, round(x, 3) AS x, round(y, 3) AS y FROM x WHERE x + hw > 0 AND x - hw < w AND y + hh > 0 AND y - hh < h""")
def watermark_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of a stamp tiled at 40 degrees over pages of each size."""
    s = F.col("p_size")
    pages = table(spark, sf_dir, "part").select("p_size").distinct().select(s.alias("page"), (300.0 + s * 7).alias("w"), (400.0 + s * 3).alias("h"), F.lit(90.0).alias("bw"), (20.0 + s).alias("bh"))
    return objects.tile_centres(pages, 40.0).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


@query("fields_after_redaction", f"""
    WITH {S_PAGES}, {S_LINES.strip()},
    m AS (SELECT DISTINCT doc_id, page_no FROM lines WHERE regexp_matches(text, '[A-Za-z0-9_%+\\-][A-Za-z0-9._%+\\-]*@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}[.\\-]*([^A-Za-z0-9.\\-]|$)'))
    SELECT doc_id, page_no FROM pg WHERE (doc_id, page_no) NOT IN (SELECT doc_id, page_no FROM m)""")
def fields_after_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one field a page, those on pages without a marked address."""
    return objects.without_redacted(bridge.doc_pages(spark, sf_dir).select("doc_id", "page_no"), marks(spark, sf_dir, ["email"]))


@query("report_notes", """
    WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'view') AS v
               FROM events WHERE event_id % 11 < 2 GROUP BY user_id),
    l AS (SELECT user_id, list_filter([CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' script' ELSE ' scripts' END END, CASE WHEN e > 0 THEN e || CASE WHEN e = 1 THEN ' note' ELSE ' notes' END END,
                                       CASE WHEN v > 0 THEN v || CASE WHEN v = 1 THEN ' link' ELSE ' links' END END], lambda x: x IS NOT NULL) AS items FROM n)
    SELECT user_id, CASE len(items) WHEN 0 THEN NULL WHEN 1 THEN 'Removed ' || items[1] || '.' ELSE 'Removed ' || array_to_string(items[1:-2], ', ') || ' and ' || items[-1] || '.' END AS note FROM l""")
def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence a user about what was removed."""
    kinds = {"click": ("script", "scripts"), "error": ("note", "notes"), "view": ("link", "links")}
    counts = table(spark, sf_dir, "events").where("event_id % 11 < 2").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    items = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.when(F.col(k) == 1, " " + a).otherwise(" " + b))) for k, (a, b) in kinds.items())))
    return counts.select("user_id", text.sentence(items).alias("note"))


@query("file_urls", """
    WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, 'https://', 'FILE://localhost/a%20b/') WHEN 1 THEN replace(url, 'https://', 'file:///x/') ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN lower(url[:7]) = 'file://' THEN CASE WHEN starts_with(p, '/') THEN p END END AS path
    FROM (SELECT page_id, url, regexp_replace(url_decode(replace(regexp_extract(url, '(?i)^file://([^?#]*)', 1), '+', '%2B')), '^localhost', '') AS p FROM u)""")
def file_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of file: addresses with a host, a query or escapes; null for other addresses."""
    url = F.col("url")
    kind = F.col("page_id") % 3
    url = F.when(kind == 0, F.replace(url, F.lit("https://"), F.lit("FILE://localhost/a%20b/"))).when(kind == 1, F.replace(url, F.lit("https://"), F.lit("file:///x/"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", text.path_of_file_url(url).alias("path"))


@query("value_texts", """
    SELECT l_orderkey, l_linenumber, CASE WHEN abs(v - round(v)) < 1e-6 THEN printf('%.0f', v) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '\\.$', '') END AS value
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity END AS v FROM lineitem)""")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.value_text(v).alias("value"))


@query("xml_escapes", """
    SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_sha256 FROM pages""")
def xml_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.xml_escape(F.col("html")), 256).alias("escaped_sha256"))


@query("ellipsis_fit", """
    SELECT p_partkey, CASE WHEN len(p_type) <= 9 THEN p_type ELSE rtrim(p_type[:8]) || '…' END AS label FROM part""")
def ellipsis_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.ellipsis(F.col("p_type"), 9).alias("label"))
