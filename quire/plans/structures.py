"""Named queries over object structures, with their SQL: twins, residue, page trees, closures, content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import closure, content, residue, trees, twins
from quire.plans.registry import query
from quire.sources.bridge import table


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, customers and orders as objects with their content, and their references."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    objects = n.select((F.col("n_nationkey").cast("long") * 3).alias("id"), F.lit("nation").alias("kind"), F.col("n_regionkey").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    objects = objects.union(c.select(F.col("c_custkey").cast("long") * 3 + 1, F.lit("customer"), "c_mktsegment", F.lit(None)))
    objects = objects.union(o.select(F.col("o_orderkey").cast("long") * 3 + 2, F.lit("order"), "o_orderstatus", "o_orderpriority"))
    refs = c.select((F.col("c_custkey").cast("long") * 3 + 1).alias("src"), F.lit("nation").alias("slot"), (F.col("c_nationkey").cast("long") * 3).alias("dst"))
    return objects, refs.union(o.select(F.col("o_orderkey").cast("long") * 3 + 2, F.lit("customer"), F.col("o_custkey").cast("long") * 3 + 1))


@query("merge_twins", """
    WITH n AS (SELECT n_nationkey AS k, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS f FROM nation),
    c AS (SELECT c_custkey AS k, min(c_custkey) OVER (PARTITION BY c_mktsegment, coalesce(f, -1 - c_nationkey)) AS f FROM customer LEFT JOIN n ON n.k = c_nationkey),
    o AS (SELECT o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_orderstatus, o_orderpriority, coalesce(f, -1 - o_custkey)) AS f FROM orders LEFT JOIN c ON c.k = o_custkey)
    SELECT k * 3 AS id, f * 3 AS keep_id, 1 AS round FROM n WHERE k <> f
    UNION ALL SELECT k * 3 + 1, f * 3 + 1, CASE WHEN EXISTS (SELECT 1 FROM customer x, customer y WHERE x.c_custkey = k AND y.c_custkey < k AND y.c_mktsegment = x.c_mktsegment AND y.c_nationkey = x.c_nationkey) THEN 1 ELSE 2 END FROM c WHERE k <> f
    UNION ALL SELECT k * 3 + 2, f * 3 + 2, least(
        CASE WHEN EXISTS (SELECT 1 FROM orders x, orders y WHERE x.o_orderkey = k AND y.o_orderkey < k AND y.o_orderstatus = x.o_orderstatus AND y.o_orderpriority = x.o_orderpriority AND y.o_custkey = x.o_custkey) THEN 1 ELSE 3 END,
        CASE WHEN EXISTS (SELECT 1 FROM orders x, orders y, customer cx, customer cy WHERE x.o_orderkey = k AND y.o_orderkey < k AND y.o_orderstatus = x.o_orderstatus AND y.o_orderpriority = x.o_orderpriority
            AND cx.c_custkey = x.o_custkey AND cy.c_custkey = y.o_custkey AND cx.c_mktsegment = cy.c_mktsegment AND cx.c_nationkey = cy.c_nationkey) THEN 2 ELSE 3 END) FROM o WHERE k <> f""")
def merge_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal nations, then customers that became equal, then orders: three rounds until nothing changes."""
    return twins.merge_twins(*_objects(spark, sf_dir), ["kind", "a", "b"])


@query("residue_search", """
    WITH t AS MATERIALIZED (SELECT *, lower(text) AS low FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'p' || page_id, html FROM pages)),
    b AS (SELECT regexp_split_to_array(trim(text), '\\s+') AS ws FROM benchmark),
    w AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS needle FROM b),
    n AS (SELECT needle, false AS match_case, length(needle) % 2 = 0 AS whole_words FROM w
          UNION SELECT c_name, true, false FROM customer UNION SELECT p_name, false, true FROM part WHERE p_name <> ''),
    grams AS MATERIALIZED (SELECT id, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS g FROM (SELECT id, string_split(low, '') AS c FROM t)),
    df AS (SELECT g, count(*) AS n FROM grams GROUP BY g),
    ng AS (SELECT needle, match_case, whole_words, unnest(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS g FROM (SELECT *, string_split(lower(needle), '') AS c FROM n)),
    rare AS (SELECT needle, match_case, whole_words, arg_min(ng.g, coalesce(n, 0)) AS g FROM ng LEFT JOIN df ON df.g = ng.g GROUP BY needle, match_case, whole_words),
    g AS (SELECT rare.*, t.id, text FROM rare JOIN grams ON grams.g = rare.g JOIN t ON t.id = grams.id WHERE contains(low, lower(needle))),
    h AS (SELECT * FROM g WHERE (NOT match_case OR contains(text, needle))
          AND (NOT whole_words OR regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])' || regexp_escape(needle) || '($|[^\\p{L}\\p{N}])')))
    SELECT needle, match_case, whole_words, count(DISTINCT id) AS n_texts, min(id) AS first_id FROM h GROUP BY ALL""")
def residue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs of the benchmark, names of customers and of parts that any text column still holds."""
    d, c, p, b, cust, part = (table(spark, sf_dir, t) for t in ("documents", "conversations", "pages", "benchmark", "customer", "part"))
    texts = d.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").union(c.select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn"), "text"))
    two = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.concat(F.element_at("ws", i), F.lit(" "), F.element_at("ws", i + 1)))
    words = b.select(F.split(F.trim("text"), r"\s+").alias("ws")).where("size(ws) > 1").select(F.explode(two).alias("needle")).select("needle", F.lit(False).alias("match_case"), (F.char_length("needle") % 2 == 0).alias("whole_words"))
    needles = words.union(cust.select("c_name", F.lit(True), F.lit(False))).union(part.select("p_name", F.lit(False), F.lit(True)))
    return residue.residue(texts.union(p.select(F.concat(F.lit("p"), "page_id"), "html")), needles)


@query("ascii_residue", """
    SELECT page_id, contains(html, 'DOCTYPE') AS as_is, contains(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ÉCOLE') AS not_ascii,
           contains(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), lower(split_part(split_part(url, '//', 2), '/', 1))) AS own_host FROM pages""")
def ascii_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page sources that hold a text of ASCII letters: with and without case, a text that is none, the page's own host."""
    html, host = F.col("html"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    found = residue.ascii_contains
    return table(spark, sf_dir, "pages").select(
        "page_id", found(html, F.lit("DOCTYPE"), F.lit(True)).alias("as_is"), found(html, F.lit("ÉCOLE"), F.lit(False)).alias("not_ascii"), found(html, host, F.lit(False)).alias("own_host")
    )


def _page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions hold nations, nations customers, customers orders; orders are pages."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    none = F.lit(None).cast("string")
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), none.alias("parent"), F.lit(0).alias("page"))
    nodes = nodes.union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(0)))
    nodes = nodes.union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit(0)))
    return nodes.union(o.select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.lit(1)))


S_TREE = """
    t AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, 0 AS page FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 0 FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 1 FROM orders)"""


@query("page_counts", f"""
    WITH RECURSIVE {S_TREE}, s AS (SELECT parent AS top, node, page FROM t WHERE parent IN (SELECT node FROM t) UNION ALL SELECT t.parent, s.node, s.page FROM s JOIN t ON t.node = s.top WHERE t.parent IS NOT NULL)
    SELECT t.node, coalesce(sum(s.page), 0)::BIGINT AS n_pages FROM t LEFT JOIN s ON s.top = t.node GROUP BY t.node""")
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every node of a page tree."""
    return trees.subtree_sums(_page_tree(spark, sf_dir), F.col("page")).withColumnRenamed("total", "n_pages")


@query("choose_catalogue", """
    WITH e AS (SELECT *, CASE event_type WHEN 'click' THEN 'Catalog' WHEN 'view' THEN 'Pages' ELSE 'Page' END AS kind, CAST(floor(value) AS BIGINT) AS n FROM events),
    g AS (SELECT user_id, max(event_id) FILTER (WHERE kind = 'Catalog' AND value > 95) AS catalogue,
                 max(struct_pack(n := coalesce(n, 0), id := event_id)) FILTER (WHERE kind = 'Pages' AND n % 4 <> 0 AND event_id % 3 = 0) AS top FROM e GROUP BY user_id)
    SELECT user_id, coalesce(catalogue, top.id) AS root, catalogue IS NULL AS made FROM g""")
def choose_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a damaged file's objects: its catalogue, or the page node to hang on a new one."""
    kind = F.when(F.col("event_type") == "click", "Catalog").when(F.col("event_type") == "view", "Pages").otherwise("Page")
    n = F.floor("value").cast("long")
    objects = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("id"), kind.alias("kind"), (F.col("value") > 95).alias("has_pages"), (n % 4 != 0).alias("has_kids"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("parent"), n.alias("count")
    )
    return trees.choose_catalogue(objects, "user_id")


S_REFS = """
    e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
          UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
          UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    k AS (SELECT 'o' || o_orderkey AS node FROM orders UNION SELECT 'p' || p_partkey FROM part UNION SELECT 's' || s_suppkey FROM supplier
          UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 'n' || n_nationkey FROM nation),
    x AS (SELECT src, dst FROM e WHERE dst NOT LIKE 'o%' AND dst IN (SELECT node FROM k)),
    s AS (SELECT 'o' || o_orderkey AS root, 'o' || o_orderkey AS node, 0 AS depth FROM orders UNION SELECT root, dst, depth + 1 FROM s JOIN x ON src = node),
    d AS (SELECT root, node, min(depth) AS depth FROM s GROUP BY root, node)"""


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References of orders (pages), parts, suppliers, customers and nations; all objects but regions; pages."""
    names = (("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"), ("part", "p"), ("orders", "o"), ("lineitem", "l"))
    t = {name: table(spark, sf_dir, name) for name, _ in names}

    def ref(name: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return t[name].select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"))

    refs = ref("lineitem", "o", "l_orderkey", "p", "l_partkey").union(ref("lineitem", "o", "l_orderkey", "s", "l_suppkey")).union(ref("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    refs = refs.union(ref("orders", "o", "o_orderkey", "c", "o_custkey")).union(ref("customer", "c", "c_custkey", "n", "c_nationkey"))
    refs = refs.union(ref("orders", "c", "o_custkey", "o", "o_orderkey")).union(ref("nation", "n", "n_nationkey", "r", "n_regionkey"))
    keys = (("orders", "o", "o_orderkey"), ("part", "p", "p_partkey"), ("supplier", "s", "s_suppkey"), ("customer", "c", "c_custkey"), ("nation", "n", "n_nationkey"))
    nodes = None
    for name, letter, key in keys:
        some = t[name].select(F.concat(F.lit(letter), key).alias("node"))
        nodes = some if nodes is None else nodes.union(some)
    return refs, nodes, t["orders"].select(F.concat(F.lit("o"), "o_orderkey").alias("node"))


@query("page_closures", f"""
    WITH RECURSIVE {S_REFS} SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS copy_no FROM d""")
def page_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order takes along when it is copied as a page; other orders are barriers, regions do not exist."""
    refs, nodes, pages = _references(spark, sf_dir)
    return closure.closures(refs, pages.withColumnRenamed("node", "root"), nodes, pages)


@query("cut_references", f"""
    WITH RECURSIVE {S_REFS}
    SELECT d.root, count(*) FILTER (WHERE t.node IS NOT NULL) AS kept, count(*) FILTER (WHERE t.node IS NULL) AS dropped
    FROM d JOIN e ON e.src = d.node LEFT JOIN d t ON t.root = d.root AND t.node = e.dst GROUP BY d.root""")
def cut_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a page's copy keeps, and those that become null."""
    refs, nodes, pages = _references(spark, sf_dir)
    return closure.closure_cuts(refs, pages.withColumnRenamed("node", "root"), nodes, pages)


S_OPS = """
    ops AS (SELECT 's' || user_id AS stream, event_id AS seq,
                   CASE event_type WHEN 'click' THEN 'Tj' WHEN 'view' THEN 'Tf' WHEN 'purchase' THEN 'Tr' WHEN 'signup' THEN 'Do' WHEN 'error' THEN CASE WHEN value < 5 THEN 'k' ELSE 'Tj' END ELSE 'Do' END AS op,
                   CASE WHEN event_type = 'view' THEN 'F' || CAST(floor(value) % 5 AS INT) ELSE 'X' || CAST(floor(value) % 7 AS INT) END AS name, CAST(floor(value) % 4 AS INT) AS number FROM events),
    u AS (SELECT DISTINCT user_id AS u FROM events),
    fonts AS (SELECT DISTINCT 'r' || u // 7 AS scope, 'F' || k AS name, 'font' || (u // 7 * 10 + k) AS font FROM u, range(4) r(k)),
    forms AS (SELECT 'r' || u // 7 AS scope, 'X' || u % 7 AS name, 's' || u AS stream, CASE WHEN u % 2 = 0 THEN 'r' || u // 14 END AS own_scope FROM u)"""


@query("font_use", f"""
    WITH RECURSIVE {S_OPS},
    a AS (SELECT *, last_value(CASE WHEN op = 'Tf' THEN name END IGNORE NULLS) OVER w AS f, last_value(CASE WHEN op = 'Tr' THEN number END IGNORE NULLS) OVER w AS m FROM ops WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    does AS (SELECT DISTINCT stream, CASE op WHEN 'Tj' THEN 'show' WHEN 'Do' THEN 'draw' ELSE 'colour' END AS kind, CASE WHEN op = 'Do' THEN name END AS name, f, m FROM a WHERE op IN ('Tj', 'Do', 'k')),
    s AS (SELECT 's' || u AS root, 's' || u AS stream, 'r' || u // 7 AS scope, NULL::VARCHAR AS font, 0 AS mode, 0 AS depth FROM u
          UNION SELECT s.root, forms.stream, coalesce(forms.own_scope, s.scope), CASE WHEN does.f IS NULL THEN s.font ELSE fonts.font END, coalesce(does.m, s.mode), s.depth + 1
          FROM s JOIN does ON does.stream = s.stream AND does.kind = 'draw' JOIN forms ON forms.scope = s.scope AND forms.name = does.name LEFT JOIN fonts ON fonts.scope = s.scope AND fonts.name = does.f WHERE s.depth < 12),
    z AS (SELECT DISTINCT root, stream, scope, font, mode FROM s),
    met AS (SELECT z.root, does.kind, CASE WHEN does.f IS NULL THEN z.font ELSE fonts.font END AS font, coalesce(does.m, z.mode) AS mode
            FROM z JOIN does ON does.stream = z.stream LEFT JOIN fonts ON fonts.scope = z.scope AND fonts.name = does.f)
    SELECT DISTINCT root, font, mode <> 3 AS visible, false AS cmyk FROM met WHERE kind = 'show' AND font IS NOT NULL
    UNION SELECT DISTINCT root, NULL, NULL, true FROM met WHERE kind = 'colour'""")
def font_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a stream of operations, seven users a scope of resources: fonts of visible and invisible text, also through forms."""
    events, kind, value = table(spark, sf_dir, "events"), F.col("event_type"), F.floor("value")
    op = F.when(kind == "click", "Tj").when(kind == "view", "Tf").when(kind == "purchase", "Tr").when(kind == "signup", "Do").when(kind == "error", F.when(F.col("value") < 5, "k").otherwise("Tj")).otherwise("Do")
    name = F.when(kind == "view", F.concat(F.lit("F"), (value % 5).cast("string"))).otherwise(F.concat(F.lit("X"), (value % 7).cast("string")))
    ops = events.select(F.concat(F.lit("s"), "user_id").alias("stream"), F.col("event_id").alias("seq"), op.alias("op"), name.alias("name"), (value % 4).cast("int").alias("number"))
    users = events.select("user_id").distinct()
    group = F.floor(F.col("user_id") / 7)
    scope = F.concat(F.lit("r"), group.cast("string")).alias("scope")
    starts = users.select(F.concat(F.lit("s"), "user_id").alias("root"), F.concat(F.lit("s"), "user_id").alias("stream"), scope)
    fonts = users.select(scope, group.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).distinct()
    fonts = fonts.select("scope", F.concat(F.lit("F"), "k").alias("name"), F.concat(F.lit("font"), (F.col("x") * 10 + F.col("k")).cast("string")).alias("font"))
    own = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("r"), F.floor(F.col("user_id") / 14).cast("string")))
    forms = users.select(scope, F.concat(F.lit("X"), F.col("user_id") % 7).alias("name"), F.concat(F.lit("s"), "user_id").alias("stream"), own.alias("own_scope"))
    return content.font_use(ops, starts, forms, fonts)
