"""The Merkle manifest against a plain recomputation."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import merkle
from tests.llm.common import awkward, empty

LOWER = {i: i + 32 for i in range(65, 91)}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, siblings of each node level by level as (before, after))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            low = k // 16 * 16
            paths[i].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 16])))
        nodes = [h("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    subs = {s: tree([leaf(r, r["text"]) for r in by[s]]) for s in sources}
    root, tops = tree([subs[s][0] for s in sources])
    out = Counter()
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(by[s], subs[s][1], strict=True):
            path, tampered = path + top, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now = leaf(r, r["text"] and r["text"].translate(LOWER)) if tampered else leaf(r, r["text"])
            for a, b in path:
                now = h(a + now + b)
            out[r["doc_id"], leaf(r, r["text"]), subs[s][0], root, h("".join(a + b for a, b in path)), now, now == root] += 1
    return out


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_brute_force(spark, height):
    """Blocks of 16 and of 4096 leaves: several traversals, one leaf alone, last runs of one node, many sources."""
    extra = [(100 + i, f"Text {i} é") for i in range(900)]
    docs = awkward(spark, extra).selectExpr("*", "case when doc_id > 700 then concat('t', doc_id) when doc_id > 650 then null else source end as s2").drop("source").withColumnRenamed("s2", "source")
    got = merkle.manifest(docs, height=height).collect()
    assert Counter(map(tuple, got)) == brute(docs.collect())
    assert {r["verified"] for r in got} == {True, False}
    assert merkle.manifest(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 16, 17, 257, 4097])
def test_one_source_of_every_height(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "concat('T', id) as text")
    got = merkle.manifest(docs).collect()
    assert Counter(map(tuple, got)) == brute(docs.collect())
    assert sum(not r["verified"] for r in got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(n))


def test_many_equal_rows(spark):
    docs = spark.range(300).selectExpr("7L as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "'same' as text")
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == brute(docs.collect())
