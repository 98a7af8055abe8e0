"""Exact dedup, Jaccard components, chunks, fingerprints: brute force and edge cases."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import chunk_dedup, exact_dedup, fingerprint, jaccard_join
from quire.plans import blocks, joins
from tests.llm.common import awkward, empty

LOWER = {i: i + 32 for i in range(65, 91)}
DATA = "/root/testdata/sf0.001"


def test_content_sort_brute_force(spark):
    docs = awkward(spark)
    got = exact_dedup.content_sort(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    assert len(got) == docs.count()
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.content_sort(empty(spark)).count() == 0


def test_content_sort_spreads_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", 20_000)
    docs = spark.range(3000).selectExpr("id as doc_id", "'Same' as text").union(spark.range(5).selectExpr("id + 9000", "concat('t', id)"))
    nulls = spark.range(200).selectExpr("cast(null as long) as doc_id", "if(id < 100, 'same', 'Other') as text")
    got = exact_dedup.content_sort(docs.union(nulls))
    sizes = got.groupBy("keep_id", "group_size").agg({"*": "count", "kept": "max"}).collect()
    assert {(r["keep_id"], r["group_size"]): r["count(1)"] for r in sizes if r["group_size"] > 1} == {(2999, 3100): 3100, (None, 100): 100}
    assert got.where("kept").count() == 7 and got.where("kept and doc_id = 2999").count() == 1
    runs, joined = exact_dedup._runs(docs, "doc_id", "text", [])
    assert runs.where("hot").select("part").distinct().count() == 12 and joined.where("best").count() == 1


def test_content_sort_needs_no_digest(spark, monkeypatch):
    """Equal texts are found by neighbouring comparisons: constant digests and hashes change no group."""
    monkeypatch.setattr(exact_dedup, "text_hash", lambda norm: F.lit(5).cast("long"))
    monkeypatch.setattr(F, "sha2", lambda col, bits: F.lit("00"))
    texts = [(i, f"{'x' * 70} tail {i % 7}") for i in range(400)] + [(1000 + i, f"t{i % 3}") for i in range(30)] + [(None, "T1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for hot in (1 << 30, 100):
        monkeypatch.setattr(exact_dedup, "HOT_BYTES", hot)
        best, count = {}, Counter()
        for i, t in texts:
            best[t.lower()] = max(best.get(t.lower(), 0), i or 0)
            count[t.lower()] += 1
        want = Counter((i, best[t.lower()], count[t.lower()], i == best[t.lower()]) for i, t in texts)
        got = exact_dedup.content_sort(docs).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_components_brute_force(spark):
    random.seed(5)
    texts, n = {}, 100
    for size in (9, 30, 120):  # dense groups with edits, chains and strangers
        base = [f"w{random.randrange(4000)}" for _ in range(size)]
        for _ in range(60):
            words = list(base)
            for _ in range(random.choice((0, 1, 1, 2, 3, 6))):
                words[random.randrange(len(words))] = f"e{random.randrange(30)}"
            texts[n] = " ".join(words)
            n += 1
    shared = " ".join(f"p{i}" for i in range(60))
    for _ in range(40):
        texts[n] = " ".join(f"u{random.randrange(10**6)}" for _ in range(random.randrange(1, 90))) + " " + shared
        n += 1
    docs = awkward(spark, list(texts.items()))
    got = jaccard_join.jaccard_components(docs)
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None})
    rows = got.collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert sorted((r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None) == [(0, None), (8, None)]
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} - {None} == {c for _, c in want.values()}
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_chunks_find_shifted_passages(spark):
    random.seed(3)

    def words(n):
        return " ".join("".join(random.choices("abcdefghij", k=random.randrange(2, 8))) for _ in range(n))

    passage = words(55)
    texts = [(i, words(80) + " " + words(i + 1) + " " + passage + " " + words(60)) for i in range(6)] + [(50 + i, words(200)) for i in range(6)]
    got = chunk_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(6)) and {r["first_doc_id"] for r in got} == {0}
    assert [r["doc_id"] for r in got if r["is_first"]] == [0]
    by = {i: t.encode() for i, t in texts}
    assert all(by[r["doc_id"]][r["start_byte"] : r["end_byte"]] in by[r["first_doc_id"]] for r in got)
    assert chunk_dedup.repeated_passages(empty(spark)).count() == 0
    odd = chunk_dedup.repeated_passages(awkward(spark)).collect()
    assert {r["doc_id"] for r in odd} == {8, 9}


def brute_passages(texts, least, across):
    """(doc, start, end of the passage) by chunk bytes themselves instead of digests."""
    places = defaultdict(set)
    chunks = {}
    for i, t in texts.items():
        data = t.encode()
        ends = chunk_dedup.cuts(np.frombuffer(data, np.uint8))
        chunks[i] = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
        for a, b in chunks[i]:
            places[data[a:b]].add((i, a))
    found = set()
    for i, t in texts.items():
        data, run = t.encode(), []
        for a, b in [*chunks[i], (-1, -1)]:
            at = places[data[a:b]] if b > a else set()
            if len({d for d, _ in at}) > 1 or (not across and len(at) > 1):
                run.append((a, b))
            else:
                if run and run[-1][1] - run[0][0] >= least:
                    found.add((i, run[0][0], run[-1][1]))
                run = []
    return found


def test_passages_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for across in (True, False):
        got = chunk_dedup.repeated_passages(docs, 120, across).collect()
        want = brute_passages(texts, 120, across)
        assert {(r["doc_id"], r["passage_start"], r["passage_end"]) for r in got} == want and want
        for r in got:  # stretches fill their passage, and their first copy is not later
            assert r["passage_start"] <= r["start_byte"] < r["end_byte"] <= r["passage_end"] and r["first_doc_id"] <= r["doc_id"]


def test_chunk_cuts_cover_and_follow_content():
    data = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    ends = chunk_dedup.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= chunk_dedup.MOST and sizes[:-1].min() >= chunk_dedup.LEAST
    moved = chunk_dedup.cuts(np.concatenate((data[:10], data)))
    assert len(set(ends) & {e - 10 for e in moved}) > 0.95 * len(ends)
    assert chunk_dedup.cuts(np.zeros(0, np.uint8)) == [] and chunk_dedup.cuts(np.full(1000, 7, np.uint8))[-1] == 1000


def test_imatch(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = fingerprint.imatch(docs).collect()
    order = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        k = len(t) // 2
        edited = t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]
        want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    by_text = defaultdict(set)
    for r in got:
        by_text[dict(order)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.7 * len(got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    odd = fingerprint.imatch(awkward(spark)).collect()
    assert len(odd) == 15 and len({r["fingerprint"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    assert fingerprint.imatch(empty(spark)).count() == 0


def xx(*values):
    """Spark's xxhash64 of ints, longs (as 'q') and strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode(), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_code(text, lexicon):
    """The sub-lexicons and hashes of a text, recomputed without Spark."""
    own = {t for t in re.split(r"[ \t\n\x0B\f\r]+", text.lower())}
    code = {}
    for sub in range(fingerprint.RATES * fingerprint.COPIES):
        h = None
        for term in sorted((t for t in own if sub in lexicon.get(t, ())), key=lambda t: t.encode()):
            h = xx(struct.pack("<i", sub), term) if h is None else xx(struct.pack("<q", h), term)
        if h is not None:
            code[sub] = h % (1 << 32)
    return code or {-1: xx(*sorted(own, key=lambda t: t.encode())) % (1 << 32)}


def plain_likeness(a, b):
    return sum(b.get(s) == h for s, h in a.items()) / len(a.keys() | b.keys())


@pytest.mark.parametrize("broadcast", [True, False])
def test_imatch_by_brute_force(spark, monkeypatch, broadcast):
    """Lexicon, fingerprints and likenesses recomputed plainly, over many blocks, by both joins."""
    if not broadcast:
        monkeypatch.setattr(joins, "MOST_BYTES", 0)
    monkeypatch.setattr(fingerprint, "blocks_of", lambda df, key: blocks.blocks_of(df, key, 20))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fingerprint.imatch(docs).collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    df = Counter(t for _, text in order for t in set(re.split(r"[ \t\n\x0B\f\r]+", text.lower())) if t)
    low, high = max(2, fingerprint.LEAST * len(order)), max(2, fingerprint.MOST * len(order))
    copies = fingerprint.COPIES
    lexicon = {
        t: {r * copies + c for r in range(fingerprint.RATES) for c in range(copies) if xx(t, struct.pack("<i", fingerprint.SEED + r * copies + c)) % (fingerprint.DENSEST << r) == 0}
        for t, n in df.items()
        if low <= n <= high
    }
    want = {}
    for i, (d, t) in enumerate(order):
        k, after = len(t) // 2, order[(i + 1) % len(order)][1]
        f, e, n = (plain_code(x, lexicon) for x in (t, t[: len(t) - k] + after[:k], after))
        shown = [" ".join(f"{s}:{h:x}" for s, h in sorted(c.items())) for c in (f, e)]
        want[d] = (*shown, plain_likeness(f, e), plain_likeness(f, n))
    assert len(got) == len(order) == 200
    assert {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got} == want
