"""N-gram Jaccard self-join by grouped prefixes, down to the components of its links.

Two documents link when the Jaccard likeness of their shingle sets reaches NUM / DEN. A document
of n shingles needs a partner that shares at least ceil(n * NUM / DEN) of them, so under any
common order of shingles two partners meet in their prefixes.

1. *Count filter.* Under hash order each document gives a prefix that is longer by ``ell(n)`` than
   the plain one; partners share at least ``ell`` tokens of it. Tokens are counted in hash buckets
   (packed arrays; a token that repeats inside a task is counted there and sent once), added up in
   parts of the documents (packed again), and documents with too few shared tokens have no partner.
   Both exchanges go digit by digit: a row packs what goes to one of FAN next places, and what is packed for
   one place is gathered before it is cut again. So rows grow in proportion to the documents, and their
   number a document is FAN / BUCKET_DOCS for each digit, however many buckets there are.
2. *Sets.* The others' whole sets are built; equal sets collapse to one representative.
3. *Grouped prefix join.* With the shingles ordered rare first, documents of one size and one
   prefix form a group. Group pairs come from prefix tokens that two groups share, filtered by size
   and by the overlap that their positions still allow. Groups expand to members, which are verified
   on whole sets.
4. *No pair rows of dense groups.* A bucket is first verified against one pivot (its member with the
   fewest shingles of its own). After that only pairs of different components matter, since links
   inside a component change nothing. In buckets of at most FEW documents they become rows; in others
   blocks of documents are verified against blocks inside a task, and only links become rows. All
   pairs across components that share a prefix token are verified.
5. *Link counts.* A link joins representatives of one component, so all pairs of representatives
   inside each component are verified, block against block. Only counts become rows, weighted by the
   number of documents of the partner's class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.components import components
from quire.llm.words import Words, mix, shingle_sets, slices
from quire.plans import scratch
from quire.plans.joins import join_small, without

NUM, DEN = 4, 5
WIDTH = 5
NO_ID = -(1 << 62)
FLUSH_TOKENS = 400_000
BUCKET_DOCS, FAN = 8000, 64
FEW = 8
BLOCK = 128
LINK_BLOCK = 256


def alpha(n):
    """Shingles that a partner of a set of n shares at least: ceil(n * NUM / DEN)."""
    return (n * NUM + DEN - 1) // DEN


def ell(n):
    return 1 + n // 20


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def digits(docs: int) -> list[int]:
    """The bases of the digits that name a bucket: FAN each, the last one less if there are several."""
    buckets, fans = max(1, docs // BUCKET_DOCS), []
    while FAN ** (len(fans) + 1) < buckets:
        fans.append(FAN)
    return [*fans, -(-buckets // FAN ** len(fans)) if fans else FAN]


def _lots(fans: list[int], level: int) -> int:
    """Groups that rows of one place are gathered in when ``level`` digits are left to be read."""
    return math.prod(fans[len(fans) - level :]) if level else 1


def _digit(x: np.ndarray, fans: list[int], k: int) -> np.ndarray:
    return ((x >> np.uint64(32)) // np.uint64(math.prod(fans[:k])) % np.uint64(fans[k])).astype(np.int64)


def _split_tokens(owner: np.ndarray, token: np.ndarray, fans: list[int], k: int, at: int, lot: int) -> Iterator[tuple]:
    """Rows of packed tokens by their k-th digit: each owner once, its number of tokens, and the tokens."""
    digit = _digit(token, fans, k)
    order = np.lexsort((owner, digit))
    digit, owner, token = digit[order], owner[order], token[order]
    edge = np.searchsorted(digit, np.arange(fans[k] + 1))
    kept = token.astype(np.uint32) if k + 1 == len(fans) else token  # the high half is for the next digits
    for d in np.flatnonzero(np.diff(edge)).tolist():
        own = owner[edge[d] : edge[d + 1]]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        times = np.diff(np.append(first, len(own))).astype(np.int32)
        yield at * fans[k] + d, lot, 1, _packed(own[first]), _packed(times), _packed(kept[edge[d] : edge[d + 1]])


TOKENS = "at long, lot long, kind int, ids binary, nums binary, vals binary"
COUNTS = "at long, lot long, ids binary, n binary, shared binary, rows binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _pack(ids: list, sizes: list, tokens: list, fans: list[int]) -> pa.RecordBatch:
    """One row of sizes and counts known at once, and one row of packed tokens for each first digit."""
    ids, sizes = np.array(ids, np.int64), np.array(sizes, np.int32)
    token = np.concatenate(tokens)
    row = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in tokens])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    copies = np.diff(np.append(np.flatnonzero(new), len(token)))
    many = np.repeat(copies >= 3, copies)
    known = np.bincount(row[many], minlength=len(ids)).astype(np.int32)
    send = ~many | new
    owner = np.where(many[send], NO_ID, ids[row[send]])  # NO_ID stands for rows that are counted already
    lot = int(mix(ids[:1].view(np.uint64))[0] % np.uint64(_lots(fans, len(fans) - 1)))
    rows = [(int(ids[0] % fans[0]), lot, 0, _packed(ids), _packed(sizes), _packed(known))]
    rows += _split_tokens(owner, mix(token[send]), fans, 0, 0, lot)
    return _batch(rows, TOKENS)


def _emit_tokens(fans: list[int]):
    """Map side of the count filter: packed prefix tokens by the bucket's first digit, and what is known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spare = NO_ID - (TaskContext.get().partitionId() << 36)  # ids for rows that have none
        ids, sizes, tokens, held = [], [], [], 0
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for a, _, data, offs in slices(batch.column(1)):
                for i, s in enumerate(shingle_sets(Words(data, offs), WIDTH), a):
                    n = len(s)
                    if raw[i] is None:
                        spare -= 1
                    ids.append(spare if raw[i] is None else raw[i])
                    sizes.append(n)
                    tokens.append(s[: n - alpha(n) + ell(n)] if n else s)
                    held += len(tokens[-1])
                if held >= FLUSH_TOKENS:
                    yield _pack(ids, sizes, tokens, fans)
                    ids, sizes, tokens, held = [], [], [], 0
        if ids:
            yield _pack(ids, sizes, tokens, fans)

    return run


def _tokens_of(table: pa.Table, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Owners and tokens of packed rows."""
    owner, token = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32 if last else np.uint64)]
    for kind, i, n, v in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "nums", "vals")), strict=True):
        if kind == 1:
            owner.append(np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int32)))
            token.append(np.frombuffer(v, token[0].dtype))
    return np.concatenate(owner), np.concatenate(token)


def _route_tokens(fans: list[int], k: int):
    """What was gathered for one place, cut by the k-th digit."""

    def run(table: pa.Table) -> pa.Table:
        at, lot = table.column("at")[0].as_py(), table.column("lot")[0].as_py()
        rows = [
            (at * fans[k] + j % fans[k], lot // fans[k], 0, *x)
            for j, (kind, *x) in enumerate(zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "nums", "vals")), strict=True))
            if kind == 0
        ]
        rows += _split_tokens(*_tokens_of(table, False), fans, k, at, lot // fans[k])
        return pa.Table.from_batches([_batch(rows, TOKENS)])

    return run


def _sums(ids: list, columns: list[list]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct ids in order, the greatest of the first column for each, and the sums of the others."""
    who, at = np.unique(np.concatenate(ids), return_inverse=True)
    n, *counts = (np.concatenate(c).astype(np.int64) for c in columns)
    most = np.zeros(len(who), np.int64)
    np.maximum.at(most, at, n)
    added = [np.zeros(len(who), np.int64) for _ in counts]
    for a, c in zip(added, counts, strict=True):
        np.add.at(a, at, c)
    return who, [most, *added]


def _split_counts(who: np.ndarray, values: list[np.ndarray], fans: list[int], k: int, at: int, lot: int) -> pa.Table:
    """Rows of packed counts by the k-th digit of the documents' parts."""
    digit = _digit(mix(who.view(np.uint64)), fans, k)
    order = np.argsort(digit, kind="stable")
    edge = np.searchsorted(digit[order], np.arange(fans[k] + 1))
    columns = [c[order] for c in (who, *values)]
    rows = [(at * fans[k] + d, lot, *(_packed(c[edge[d] : edge[d + 1]]) for c in columns)) for d in np.flatnonzero(np.diff(edge)).tolist()]
    return pa.Table.from_batches([_batch(rows, COUNTS)])


def _count_bucket(fans: list[int]):
    """Shared tokens of one bucket added up by document, packed by the first digit of the documents' parts."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes, shared, rows = [], [], [], []
        for kind, i, n, v in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "nums", "vals")), strict=True):
            if kind == 0:
                ids.append(np.frombuffer(i, np.int64))
                sizes.append(np.frombuffer(n, np.int32))
                shared.append(np.frombuffer(v, np.int32))
                rows.append(np.ones(len(ids[-1]), np.int32))
        owner, token = _tokens_of(table, True)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        same = token[1:] == token[:-1]
        both = (np.append(same, False) | np.append(False, same))[: len(owner)]
        who, times = np.unique(owner[both & (owner != NO_ID)], return_counts=True)
        ids.append(who)
        sizes.append(np.zeros(len(who), np.int32))
        shared.append(times.astype(np.int32))
        rows.append(np.zeros(len(who), np.int32))
        who, values = _sums(ids, [sizes, shared, rows])
        return _split_counts(who, values, fans, 0, 0, table.column("at")[0].as_py() % _lots(fans, len(fans) - 1))

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, *columns = ([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)] for c in ("ids", "n", "shared", "rows"))
    return _sums(ids, columns)


def _route_counts(fans: list[int], k: int):
    """Counts gathered for one place, added up and cut by the k-th digit."""

    def run(table: pa.Table) -> pa.Table:
        at, lot = table.column("at")[0].as_py(), table.column("lot")[0].as_py()
        return _split_counts(*_added(table), fans, k, at, lot // fans[k])

    return run


def _count_part(table: pa.Table) -> pa.Table:
    """What all buckets counted of one part of the documents, added up."""
    who, (n, shared, rows) = _added(table)
    return pa.table({"doc": pa.array(who), "n": pa.array(n.astype(np.int32)), "shared": pa.array(shared), "rows": pa.array(rows)})


def shared_tokens(docs: DataFrame, fans: list[int]) -> DataFrame:
    """(doc, n, shared, rows): a document's shingles, its prefix tokens that others have too, and its rows."""
    rows = docs.mapInArrow(_emit_tokens(fans), TOKENS)
    for k in range(1, len(fans)):
        rows = rows.groupBy("at", "lot").applyInArrow(_route_tokens(fans, k), TOKENS)
    rows = rows.groupBy("at", "lot").applyInArrow(_count_bucket(fans), COUNTS)
    for k in range(1, len(fans)):
        rows = rows.groupBy("at", "lot").applyInArrow(_route_counts(fans, k), COUNTS)
    return rows.groupBy("at", "lot").applyInArrow(_count_part, "doc long, n int, shared long, rows long")


def _build_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        raw = batch.column(0).to_pylist()
        for a, _, data, offs in slices(batch.column(1)):
            out = [[], [], [], [], []]
            for i, s in enumerate(shingle_sets(Words(data, offs), WIDTH), a):
                with np.errstate(over="ignore"):
                    sig = [int(mix(s + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2)]
                for o, x in zip(out, (raw[i], len(s), *sig, _packed(s)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc", "n", "sig1", "sig2", "hashes"])


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good[i] = common * den >= (len(x) + len(y) - common) * num
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def links_of(pairs: DataFrame, sets: DataFrame, name: str, num: int = NUM, den: int = DEN) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough; only sets of paired documents move."""
    pairs = scratch.write(pairs, f"{name}_pairs")
    used = scratch.write(pairs.select(F.col("a").alias("d")).union(pairs.select("b")).distinct(), f"{name}_used")
    sets = join_small(sets.select("doc", "hashes"), used, sets["doc"] == F.col("d"), "left_semi", used.count())
    x = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return both.mapInArrow(_verify(num, den), "a long, b long")


def _alike(table: pa.Table, num: int, den: int) -> np.ndarray:
    """Which sets of a task link with which, by matrix products."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
    size = np.array([len(s) for s in sets])
    token, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # a token of one set can't be shared
    shared = times[inverse] > 1
    row, col = np.repeat(np.arange(len(sets)), size)[shared], column[inverse][shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for c in range(0, int(col.max(initial=-1)) + 1, step):
        x, y = np.searchsorted(col, (c, c + step))
        part = np.zeros((len(sets), step), np.float32)
        part[row[x:y], col[x:y] - c] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    return common * den >= (size[:, None] + size[None, :] - common) * num


def _block_links(num: int, den: int):
    """Links between the two sides of one pair of blocks, or inside one block."""

    def run(table: pa.Table) -> pa.Table:
        side, doc, comp = (table.column(c).to_numpy() for c in ("side", "doc", "c"))
        good = _alike(table, num, den)
        good &= comp[:, None] != comp[None, :]
        good &= (side[:, None] < side[None, :]) | (side.min() == side.max())
        a, b = np.nonzero(good)
        return pa.table({"a": pa.array(doc[a]), "b": pa.array(doc[b])})

    return run


def _block_counts(table: pa.Table) -> pa.Table:
    """Documents that each set of one pair of blocks, or of one block, links with there."""
    side, doc, size = (table.column(c).to_numpy() for c in ("side", "doc", "size"))
    good = _alike(table, NUM, DEN)
    if all(table.column(f"i{x}")[0] == table.column(f"j{x}")[0] for x in "kzm"):
        np.fill_diagonal(good, False)
    else:
        good &= side[:, None] != side[None, :]
    links = good.astype(np.int64) @ size.astype(np.int64)
    return pa.table({"doc": pa.array(doc[links > 0]), "links": pa.array(links[links > 0])})


def with_main(rest: DataFrame) -> DataFrame:
    """``rest`` (h, doc, c, ..) with df, the rows of a bucket h, and main, its component of the most documents.

    Buckets that share a large component become one cluster, and its documents meet each other in no other one.
    """
    crowds = rest.select("doc", "c").distinct().groupBy("c").agg(F.count("*").alias("docs")).where("docs > 1")
    crowds = scratch.write(crowds.withColumnRenamed("c", "of"), "crowds")
    sized = join_small(rest.select("h", "c"), crowds, F.col("c") == F.col("of"), "left", crowds.count())
    first = F.struct(-F.coalesce("docs", F.lit(1)), F.col("c"))
    return rest.join(sized.groupBy("h").agg(F.count("*").alias("df"), F.min_by("c", first).alias("main")), "h")


def dense_links(rest: DataFrame, sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Links across components in buckets of many documents.

    Buckets of one main component are one cluster. Its documents outside that component are cut into
    blocks of about BLOCK and meet each other's blocks and those of the main component: all pairs that
    sizes allow are verified on whole sets, block against block, and only links become rows.
    """
    return _block_pairs(rest, sets.select("doc", "hashes"), BLOCK, num, den).applyInArrow(_block_links(num, den), "a long, b long")


def _block_pairs(rest: DataFrame, sets: DataFrame, block: int, num: int = NUM, den: int = DEN):
    """The sets of each pair of blocks of a cluster ``main``, but not of two blocks of its main component.

    Blocks hold sets of one size class z. Sets that link differ in size by at most den / num, so classes a little
    wider than that meet only themselves and their neighbours; no other block pair is sent anywhere.
    """
    docs = rest.select("main", "doc", "c", (F.col("c") != F.col("main")).alias("minor")).distinct()
    used = scratch.write(docs.select(F.col("doc").alias("d")).distinct(), "dense_used")
    sets = join_small(sets, used, sets["doc"] == F.col("d"), "left_semi", used.count())
    z = F.floor(F.log(F.octet_length("hashes") / 8) / (1.0001 * math.log(den / num))).cast("int")
    docs = scratch.write(docs.join(sets.select("doc", z.alias("z")), "doc"), "dense")
    sizes = docs.groupBy("main", "z").agg(*(F.ceil(F.count_if(x) / block).cast("int").alias(n) for x, n in ((F.col("minor"), "nm"), (~F.col("minor"), "nj"))))
    # At most a hundred classes a cluster: sizes are numbers of 32 bits.
    sizes = sizes.groupBy("main").agg(F.map_from_entries(F.collect_list(F.struct("z", F.struct("nm", "nj")))).alias("of"))
    own = docs.join(sizes, "main")
    here = F.col("of")[F.col("z")]
    own = own.withColumn("k", F.pmod(F.xxhash64("doc"), F.when(F.col("minor"), here["nm"]).otherwise(here["nj"])).cast("int"))

    def upto(n: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda k: k < n)

    def task(ik: Column, iz: Column, jk: Column, jz: Column, major: bool, side: Column) -> Column:
        return F.struct(ik.alias("ik"), iz.alias("iz"), F.lit(0).alias("im"), jk.alias("jk"), jz.alias("jz"), F.lit(int(major)).alias("jm"), side.cast("int").alias("side"))

    k, z = F.col("k"), F.col("z")

    def onto_minor(step: int) -> Column:
        """Tasks of a minor block with the minor blocks of the class ``step`` away: the lower block is side 0."""
        if step == 0:
            return F.transform(upto(F.col("of")[z]["nm"]), lambda x: task(F.least(k, x), z, F.greatest(k, x), z, False, k > x))
        if step < 0:
            return F.transform(upto(F.col("of")[z + step]["nm"]), lambda x: task(x, z + step, k, z, False, F.lit(1)))
        return F.transform(upto(F.col("of")[z + step]["nm"]), lambda x: task(k, z, x, z + step, False, F.lit(0)))

    def onto_main(step: int) -> Column:
        return F.transform(upto(F.col("of")[z + step]["nj"]), lambda x: task(k, z, x, z + step, True, F.lit(0)))

    def from_main(step: int) -> Column:
        return F.transform(upto(F.col("of")[z + step]["nm"]), lambda x: task(x, z + step, k, z, True, F.lit(1)))

    of_minor = [f(step) for step in (-1, 0, 1) for f in (onto_minor, onto_main)]
    of_main = [from_main(step) for step in (-1, 0, 1)]
    tasks = own.withColumn("t", F.explode(F.when(F.col("minor"), F.concat(*of_minor)).otherwise(F.concat(*of_main))))
    return tasks.select("main", "t.*", "doc", "c").join(sets, "doc").groupBy("main", "ik", "iz", "im", "jk", "jz", "jm")


def _may_link(n1: str, p1: str, n2: str, p2: str):
    """Size filter, and the overlap that positions p1 and p2 of a common token still allow."""
    n1, p1, n2, p2 = (F.col(c) for c in (n1, p1, n2, p2))
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    return (least * DEN >= most * NUM) & (F.least(n1 - p1, n2 - p2) * (NUM + DEN) >= (n1 + n2) * NUM)


def _prefixes(sets: DataFrame) -> DataFrame:
    """(doc, n, pos, h): prefix tokens, rare first, of which two sets at least have a copy.

    A token of one set only can't be shared; such tokens come first and so only move positions.
    """
    # mapInArrow turns the packed hashes into a long array; all else is SQL.
    rows = sets.select("doc", "n", "hashes").mapInArrow(_as_longs, "doc long, n int, h array<long>").select("doc", "n", F.explode("h").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "h")
    by_doc = Window.partitionBy("doc")
    plain = F.col("n") - F.floor((F.col("n") * NUM + DEN - 1) / DEN).cast("int") + 1
    return (
        shared.withColumn("own", F.col("n") - F.count("*").over(by_doc))
        .withColumn("pos", (F.col("own") + F.row_number().over(by_doc.orderBy("df", "h")) - 1).cast("int"))
        .where(F.col("pos") < plain)
        .select("doc", "n", "pos", "h")
    )


def _as_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
        offs = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["doc", "n", "h"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    Null texts are empty; a document without words has 0 shingles and is linked with nothing. Rows
    with a null id come back with their size and a null component. Of repeated ids one row is
    returned, with the largest size; it links by the set with the smallest signature. An empty
    input gives an empty result. Other columns are ignored.
    """
    counted, member, _, label = _joined(docs, id_col, text_col)
    chosen = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("doc"), F.coalesce("component", "rep").alias("component")
    )
    # A component's smallest node is the smallest representative, which is its class's smallest id.
    real = F.col("doc") >= NO_ID
    return counted.join(chosen, "doc", "left").select(
        F.when(real, F.col("doc")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(real, F.coalesce("component", "doc")).alias("component_id"),
    )


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``jaccard_components`` with class_id and n_links.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` the number of other documents
    (ids) that a document is linked with, those of its own class included. Both are null without an id.
    """
    counted, member, sets, label = _joined(docs, id_col, text_col)
    classes = scratch.write(member.groupBy("rep").agg(F.count("*").alias("size")), "classes")
    # The smallest representative stands as its cluster's main component, each other one by itself.
    inside = label.select(F.col("component").alias("main"), F.col("node").alias("doc"), F.col("node").alias("c"))
    sized = sets.join(classes.withColumnRenamed("rep", "doc"), "doc").select("doc", "hashes", "size")
    links = scratch.write(_block_pairs(inside, sized, LINK_BLOCK).applyInArrow(_block_counts, "doc long, links long"), "n_links")
    links = links.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    by_class = scratch.write(classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left"), "by_class")
    own = join_small(member, by_class, ["rep"], "left", by_class.count())
    real = F.col("doc") >= NO_ID
    return counted.join(own, "doc", "left").select(
        F.when(real, F.col("doc")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(real, F.coalesce("component", "rep", "doc")).alias("component_id"),
        F.when(real, F.coalesce("rep", "doc")).alias("class_id"),
        F.when(real, F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
    )


def _joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(counted, member, sets of representatives, label): the join down to the components of its links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    counted = scratch.write(shared_tokens(docs, digits(docs.count())), "counted")
    least = F.floor((F.col("n") * NUM + DEN - 1) / DEN)
    open_ = counted.where((F.col("doc") >= NO_ID) & (F.col("n") > 0) & (F.col("shared") >= 1 + F.floor(least / 20)))
    open_ = scratch.write(open_.select(F.col("doc").alias("doc_"), "rows"), "open")
    left = open_.count()
    sets = join_small(docs, open_.select("doc_"), docs["doc"] == F.col("doc_"), "left_semi", left).mapInArrow(
        _build_sets, "doc long, n int, sig1 long, sig2 long, hashes binary"
    )
    twice = open_.where("rows > 1").select("doc_")
    sets = scratch.write(sets, "sets")
    if n_twice := twice.count():
        again = join_small(sets, twice, sets["doc"] == F.col("doc_"), "left_semi", n_twice)
        once = join_small(sets, twice, sets["doc"] == F.col("doc_"), "left_anti", n_twice)
        pick = F.min_by(F.struct("n", "sig1", "sig2", "hashes"), F.struct("sig1", "sig2"))
        sets = once.union(again.groupBy("doc").agg(pick.alias("x")).select("doc", "x.*"))

    # Equal sets: by blocks of ids first, so that no group of copies meets in one task.
    block = F.shiftright("doc", 8).alias("block")
    keys = sets.select("doc", "n", "sig1", "sig2", block)
    small = keys.groupBy("sig1", "sig2", "n", "block").agg(F.min("doc").alias("low"))
    reps = small.groupBy("sig1", "sig2", "n").agg(F.min("low").alias("rep"))
    small = small.join(reps, ["sig1", "sig2", "n"]).select("sig1", "sig2", "n", "block", "rep")
    member = scratch.write(keys.join(small, ["sig1", "sig2", "n", "block"]).select("doc", "rep"), "member")
    copy = scratch.write(member.where("doc != rep").select(F.col("doc").alias("copy")), "copies")
    sets = join_small(sets, copy, sets["doc"] == F.col("copy"), "left_anti", copy.count()).select("doc", "n", "hashes")

    prefixes = scratch.write(_prefixes(sets), "prefixes")
    # Documents of one size and one prefix are a group, named by its smallest member.
    by_group = (
        prefixes.groupBy("doc", "n")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("prefix"))
        .select("doc", "n", F.xxhash64("prefix").alias("k1"), F.hash("prefix").alias("k2"))
    )
    groups = by_group.groupBy("n", "k1", "k2").agg(F.min("doc").alias("gid"))
    grouped = scratch.write(by_group.join(groups, ["n", "k1", "k2"]).select("doc", "gid"), "groups")
    heads = prefixes.join(grouped.where("doc = gid").select("doc"), "doc", "left_semi")
    pivot = heads.groupBy("h").agg(
        F.min(F.struct("pos", "doc", "n")).alias("p"), F.count("*").alias("df")
    ).where("df > 1")
    starred = heads.join(pivot.select("h", F.col("p.pos").alias("pos_p"), F.col("p.doc").alias("p"), F.col("p.n").alias("n_p")), "h")
    stars = starred.where((F.col("p") != F.col("doc")) & _may_link("n", "pos", "n_p", "pos_p")).select(
        F.col("p").alias("a"), F.col("doc").alias("b")
    )
    own = grouped.where("doc != gid").select(F.col("gid").alias("a"), F.col("doc").alias("b"))
    first = scratch.write(links_of(stars.union(own).distinct(), sets, "star"), "links")
    label = scratch.write(components(first), "labels")

    # What is left: pairs of different components that share a prefix token.
    rows = prefixes.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    rows = scratch.write(rows.select("doc", "n", "pos", "h", "c"), "rows")
    mixed = rows.groupBy("h").agg(
        F.count("*").alias("df"), F.min("c").alias("low"), F.max("c").alias("high"), F.min_by("c", F.struct("pos", "doc")).alias("main")
    )
    rest = scratch.write(rows.join(mixed.where("low != high").select("h", "df", "main"), "h"), "mixed")
    few = rest.where(F.col("df") <= FEW)
    minor = few.where("c != main").select("h", *(F.col(c).alias(f"{c}_m") for c in ("doc", "n", "pos", "c")))
    pairs = minor.join(few, "h").where(
        (F.col("c") != F.col("c_m"))
        & ((F.col("c") == F.col("main")) | (F.col("doc") < F.col("doc_m")))
        & _may_link("n", "pos", "n_m", "pos_m")
    )
    second = links_of(pairs.select(F.col("doc_m").alias("a"), F.col("doc").alias("b")).distinct(), sets, "few")
    third = dense_links(rest.where(F.col("df") > FEW), sets)
    known = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    joined = scratch.write(second.union(third).union(known), "joined")
    label = components(joined)
    return counted, member, sets, label


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay: of each component those with the smallest id; rows with a null id stay.

    Where an id stands for several texts, each (id, text) is joined by its own set, and of texts of one
    id in one component one stays.
    """
    if not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return _one_of_each_text(docs, id_col, text_col)
    gone = scratch.write(jaccard_components(docs, id_col, text_col).where("component_id != doc_id").select("doc_id"), "gone")
    return without(docs, [F.col(id_col).cast("long")], gone, gone.count())


def _one_of_each_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``one_of_each`` for ids that repeat: every (id, text) gets a number that stands for it in the join."""
    i, t, h = F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.where(F.col(id_col).isNotNull()).select(i.alias("i"), h.alias("h"), t.alias("t"))
    numbers = scratch.write(texts.select("i", "h").distinct().withColumn("k", F.monotonically_increasing_id()), "numbers")
    keyed = scratch.write(texts.join(numbers, ["i", "h"]).select("k", "t"), "keyed")
    found = jaccard_components(keyed, "k", "t").select(F.col("doc_id").alias("k"), "component_id").join(numbers, "k")
    found = scratch.write(found.select("i", "h", "k", "component_id"), "found")
    first = found.groupBy("component_id").agg(F.min(F.struct("i", "k"))["k"].alias("first"))
    gone = scratch.write(found.join(first, "component_id").where("k != first").select("i", "h"), "gone")
    return without(docs, [i, h], gone, gone.count())
