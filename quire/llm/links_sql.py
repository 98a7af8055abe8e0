"""Jaccard links of whole shingle sets and their components in DuckDB's SQL, by a plain self-join."""

from __future__ import annotations


def links_sql(percent: int) -> str:
    """CTEs d (doc_id, n, shingles), link (a, b, both ways) and top (doc_id, component_id) at a likeness of ``percent``."""
    return f"""
        WITH RECURSIVE t AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        d AS MATERIALIZED (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM t),
        s AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS h FROM d),
        met AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b, c = na AND c = nb AS same FROM met WHERE 100 * c >= {percent} * (na + nb - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT link.b, reach.other FROM reach JOIN link ON link.a = reach.doc_id),
        top AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)"""


NEAR_SQL = links_sql(85) + """
        SELECT d.doc_id, len(d.shingles)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN top USING (doc_id)
    """

JACCARD_SQL = links_sql(80) + """
        SELECT d.doc_id, len(d.shingles)::BIGINT AS n_shingles, component_id, least(d.doc_id, coalesce(min(b) FILTER (WHERE same), d.doc_id)) AS class_id, count(b) AS n_links
        FROM d JOIN top USING (doc_id) LEFT JOIN link ON link.a = d.doc_id GROUP BY d.doc_id, d.shingles, component_id
    """
