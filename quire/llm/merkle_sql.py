"""The Merkle manifest in DuckDB's SQL, level by level."""

from __future__ import annotations

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc(text: str) -> str:
    """CRC-32 of ASCII text, a bit at a time: list_reduce goes over the start value, the bytes and eight shifts after each."""
    step = "CASE WHEN x >= 1024 THEN xor(a, x - 1024) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [1024 + ascii({text}[i]), 0, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, x: {step}), 4294967295)"


def _levels(name: str, tree: str, order: str, value: str, rows: str, n: int) -> str:
    """CTEs name_0 to name_n of (tree, i, d, left, right, many): the nodes of a tree's levels and their siblings."""
    run = "OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN {})"
    out = [f"{name}_r0 AS (SELECT {tree} AS tree, row_number() OVER (PARTITION BY {tree} ORDER BY {order}) - 1 AS i, {value} AS d FROM {rows})"]
    for k in range(n):
        out.append(
            f"{name}_{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many,"
            f" coalesce(string_agg(d, '') {run.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') AS l,"
            f" coalesce(string_agg(d, '') {run.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') AS r FROM {name}_r{k})"
        )
        out.append(
            f"{name}_r{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN bool_or(many) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d"
            f" FROM {name}_{k} GROUP BY tree, i // 16)"
        )
    return ",\n".join(out)


def merkle_sql(leaf_levels: int = 5, source_levels: int = 3) -> str:
    """SQL for sources of at most 16 ** leaf_levels rows and 16 ** source_levels sources."""
    a, b = range(leaf_levels), range(source_levels)
    up_a = [f"x{k}" for k in a]
    joins = [f"JOIN a_{k} x{k} ON x{k}.tree = w.tree AND x{k}.i = w.i // {16**k}" for k in a]
    joins += [f"JOIN b_{k} y{k} ON y{k}.i = w.tree // {16**k}" for k in b]
    steps = [*up_a, *(f"y{k}" for k in b)]
    proof = " || ".join(f"CASE WHEN {s}.many THEN {s}.l || {s}.r ELSE '' END" for s in steps)
    cols = ", ".join(f"{s}.l AS {s}l, {s}.r AS {s}r, {s}.many AS {s}m" for s in steps)
    folds, before = [], "f0"
    for k, s in enumerate(steps):
        folds.append(f"f{k + 1} AS (SELECT * EXCLUDE (f, {s}l, {s}r, {s}m), CASE WHEN {s}m THEN sha256({s}l || f || {s}r) ELSE f END AS f FROM {before})")
        before = f"f{k + 1}"
    return f"""
        WITH s AS (
            SELECT source AS s, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
        w0 AS (
            SELECT tree, doc_id, {_leaf('text')} AS leaf,
                   CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS now
            FROM documents JOIN s ON source IS NOT DISTINCT FROM s),
        w AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM w0),
        {_levels('a', 'tree', 'i', 'leaf', 'w', leaf_levels)},
        {_levels('b', '0', 'tree', 'd', f'a_r{leaf_levels}', source_levels)},
        f0 AS (
            SELECT w.doc_id, w.leaf, t.d AS subroot, (SELECT d FROM b_r{source_levels}) AS root, sha256({proof}) AS proof_sha256, {cols}, w.now AS f
            FROM w JOIN a_r{leaf_levels} t ON t.tree = w.tree {' '.join(joins)}),
        {", ".join(folds)}
        SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {before}
    """
