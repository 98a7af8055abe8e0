"""Merkle manifest of a dataset: a digest for every row, source and the whole, and each row's proof.

A row's leaf is the SHA-256 of its fields. In each source leaves ascend by id; while a level has several
nodes, every FAN consecutive ones become their digest. The sources' roots are the leaves of one more tree.

1. *Order.* Narrow rows (source, id, leaf) are sorted by range, whatever their sources; one row for each
   partition, and one for each source in a partition, turn a row's number there into its place in its source.
2. *Traversal.* FAN ** HEIGHT consecutive nodes of a tree, aligned, are one block and one task. ``walk`` goes
   through it in postorder: it returns the digest of a subtree, and while it unwinds it appends to each
   contained leaf the siblings on its left and right. The roots of blocks are the nodes of the next traversal,
   until each tree has one node.
3. *Proofs.* Siblings of blocks go down from the roots to the blocks of leaves. There the leaves' own
   siblings are put before them, hashed, and folded with the leaf, or with a tampered one, up to the root.

No task sees more than a block, and a join key has at most a block of rows; texts are read once and never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.exact_dedup import ascii_lower
from quire.plans import scratch
from quire.plans.blocks import number_in_order
from quire.plans.joins import join_small

FAN = 16
HEIGHT = 3
PATH = "array<struct<left:string,right:string>>"
_IN_PARTITION = (1 << 33) - 1  # Spark's increasing ids: the partition above 33 bits, the row's number below


def block_of(pos: str, height: int) -> Column:
    return F.floor(F.col(pos) / FAN**height).cast("long")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int, most: int) -> int:
    """Levels above ``n`` nodes until one is left, at most ``most``."""
    h = 0
    while h < most and FAN**h < n:
        h += 1
    return h


def walk(nodes: list[str], paths: list[list[tuple[str, str]]], low: int, high: int, height: int) -> str:
    """The digest of nodes low to high - 1, ``height`` levels up; leaves get their siblings of each level, lowest first."""
    if height == 0:
        return nodes[low]
    step = FAN ** (height - 1)
    starts = range(low, high, step)
    roots = [walk(nodes, paths, a, min(a + step, high), height - 1) for a in starts]
    for i, a in enumerate(starts):
        beside = ("".join(roots[:i]), "".join(roots[i + 1 :]))
        for path in paths[a : min(a + step, high)]:
            path.append(beside)
    return digest("".join(roots))


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and the siblings on its way up."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field_text(f) for f in fields)), 256))


def _leaf_blocks(height: int):
    """One row for a block of leaves: its root, and its rows packed in order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes = [x.hex() for x in table.column("leaf").to_pylist()]
        n = table.column("n")[0].as_py()
        up = height_of(n, height)
        return pa.table(
            {
                "tree": table.column("tree")[:1],
                "pos": table.column("block")[:1],
                "n": pa.array([-(-n // FAN**height)]),
                "digest": pa.array([walk(nodes, [[] for _ in nodes], 0, len(nodes), up)]),
                "height": pa.array([up], pa.int32()),
                **{f"{c}s": pa.array([table.column(c).to_pylist()], pa.list_(k)) for c, k in (("doc_id", pa.int64()), ("leaf", pa.binary()), ("forged", pa.binary()))},
            }
        )

    return run


LEAF_BLOCK = "tree long, pos long, n long, digest string, height int, doc_ids array<long>, leafs array<binary>, forgeds array<binary>"


def _climb(height: int):
    """A row with its siblings for each node of a block, and one row for the block's root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes, n = table.column("digest").to_pylist(), table.column("n")[0].as_py()
        paths = [[] for _ in nodes]
        root = walk(nodes, paths, 0, len(nodes), height_of(n, height))
        tree, above = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
        rows = [{"tree": tree, "pos": p, "path": [{"left": a, "right": b} for a, b in path]} for p, path in zip(table.column("pos").to_pylist(), paths, strict=True)]
        rows.append({"tree": tree, "pos": above, "n": -(-n // FAN**height), "digest": root})
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.Table.from_pylist(rows, pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("path", kind)]))

    return run


def traverse(nodes: DataFrame, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (tree, digest) of trees of nodes (tree, pos, n, digest), and each traversal's paths (tree, pos, path).

    Blocks of nodes are traversed side by side, and their roots are the nodes of the next round. A tree of one node
    is its own root; its paths are empty.
    """
    levels = []
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        made = nodes.where("n > 1").withColumn("block", block_of("pos", height)).groupBy("tree", "block").applyInArrow(_climb(height), f"tree long, pos long, n long, digest string, path {PATH}")
        made = scratch.write(made, "traversal")
        done = nodes.where("n = 1")
        levels.append(made.where("digest is null").select("tree", "pos", "path").union(done.select("tree", "pos", F.array().cast(PATH))))
        nodes = made.where("digest is not null").select("tree", "pos", "n", "digest").union(done.select("tree", "pos", "n", "digest"))
    return nodes.select("tree", "digest"), levels


def descend(top: DataFrame, levels: list[DataFrame], height: int) -> DataFrame:
    """(tree, pos, path, ...) of the lowest nodes: what ``top`` (tree, path, ...) has above the roots comes after their own paths."""
    down = top.withColumn("pos", F.lit(0).cast("long"))
    kept = [c for c in top.columns if c not in ("tree", "path")]
    for level in reversed(levels):
        up = down.select(F.col("tree").alias("t"), F.col("pos").alias("p"), F.col("path").alias("above"), *kept)
        same = (F.col("tree") == F.col("t")) & (block_of("pos", height) == F.col("p"))
        down = level.join(up, same).select("tree", "pos", F.concat("path", "above").alias("path"), *kept)
    return down


def _prove(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = [x.hex() for x in row["leafs"]]
                paths = [[] for _ in leaves]
                walk(leaves, paths, 0, len(leaves), row["height"])
                above = [(x["left"], x["right"]) for x in row["path"]]
                proofs, folded = [], []
                for leaf, forged, path in zip(leaves, row["forgeds"], paths, strict=True):
                    path += above
                    proofs.append(digest("".join(a + b for a, b in path)))
                    folded.append(fold(leaf if forged is None else forged.hex(), path))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "leaf": leaves,
                        "subroot": [row["subroot"]] * len(leaves),
                        "root": [root] * len(leaves),
                        "proof_sha256": proofs,
                        "folded_root": folded,
                        "verified": [f == root for f in folded],
                    }
                )

    return run


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def in_sources(leaves: DataFrame) -> DataFrame:
    """Rows (tree, pos, n, doc_id, leaf, forged): a source's number (from 0, null first), the leaf's there, and its leaves."""
    spark = leaves.sparkSession
    parts, order = int(spark.conf.get("spark.sql.shuffle.partitions")), ["source", "doc_id", "leaf", "k"]
    ordered = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("g", F.monotonically_increasing_id())
    ordered = scratch.write(ordered.drop("k"), "ordered").withColumn("part", F.shiftright("g", 33)).withColumn("i", F.col("g").bitwiseAND(_IN_PARTITION))
    runs = scratch.write(ordered.groupBy("part", "source").agg(F.min("i").alias("i0"), F.count("*").alias("m")), "runs")
    sizes = runs.groupBy("part").agg(F.sum("m").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    runs = runs.join(F.broadcast(sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))), F.col("part") == F.col("p"))
    runs = runs.withColumn("at", F.col("ahead") + F.col("i0")).drop("p")
    sources = runs.groupBy(F.col("source").alias("s")).agg(F.min("at").alias("first"), F.sum("m").alias("n"))
    sources = scratch.write(number_in_order(sources, [], "first", "no").select("s", "first", "n", (F.col("no") - 1).alias("tree")), "sources")
    runs = join_small(runs, sources, F.col("source").eqNullSafe(F.col("s")), "inner", sources.count(), 200)
    runs = scratch.write(runs.select(F.col("part").alias("p"), "s", "tree", "n", (F.col("ahead") - F.col("first")).alias("shift")), "shifts")
    same = (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))
    placed = join_small(ordered, runs, same, "inner", runs.count(), 200)
    return placed.select("tree", (F.col("i") + F.col("shift")).alias("pos"), "n", "doc_id", "leaf", "forged")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), every: int = 5, height: int = HEIGHT) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` are the columns that a leaf covers. Where ``every`` divides the CRC-32 of the id as text, the
    last of them is tampered with (its A-Z lower-cased): ``folded_root`` follows from the tampered leaf and
    the untampered siblings, and ``verified`` says whether it still is the root.

    A null field counts as ``-``; a null source is a source, the first. Rows with a null id come first in
    their source and are never tampered with; rows of one id follow each other by their leaf, and whole rows
    that repeat are interchangeable. A null text stays null. An empty input gives an empty result; other
    columns are ignored.
    """
    own = [F.col(f"`{f}`") for f in fields]
    id_, text = F.col("doc_id").cast("long"), own[-1].cast("string")
    tampered = F.crc32(id_.cast("string")) % every == 0
    forged = F.when(text.isNotNull(), ascii_lower(text))
    leaves = docs.select(
        F.col("source").cast("string").alias("source"),
        id_.alias("doc_id"),
        leaf_of(own).alias("leaf"),
        F.when(tampered, leaf_of([*own[:-1], forged])).alias("forged"),
        F.monotonically_increasing_id().alias("k"),  # parts rows that are equal
    )
    leaves = in_sources(scratch.write(leaves, "leaves"))
    blocks = scratch.write(leaves.withColumn("block", block_of("pos", height)).groupBy("tree", "block").applyInArrow(_leaf_blocks(height), LEAF_BLOCK), "blocks")
    roots, levels = traverse(blocks.select("tree", "pos", "n", "digest"), height)
    roots = scratch.write(roots, "subroots")
    count = roots.count()
    top, top_levels = traverse(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest"), height)
    root = (top.first() or {"digest": ""})["digest"]
    crown = descend(docs.sparkSession.createDataFrame([(0, [])], f"tree long, path {PATH}"), top_levels, height).select(F.col("pos").alias("tree"), "path")
    down = descend(crown.join(roots.withColumnRenamed("digest", "subroot"), "tree"), levels, height)
    proved = blocks.drop("n", "digest").join(down, ["tree", "pos"])
    return proved.select("height", "doc_ids", "leafs", "forgeds", "path", "subroot").mapInArrow(_prove(root), MANIFEST)
