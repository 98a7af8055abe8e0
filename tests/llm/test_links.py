"""Link counts of the Jaccard join against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import jaccard_join
from quire.llm import jaccard_join as j
from tests.llm.common import awkward
from tests.llm.test_dedup import brute_components, shingles


def test_every_link_inside_a_component_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", 16)  # many blocks, some of them empty
    random.seed(11)
    texts, n = [], 100
    for size, copies in ((30, 25), (90, 60)):
        base = [f"w{random.randrange(4000)}" for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(random.choice((0, 0, 1, 2, 3))):
                words[random.randrange(size)] = f"e{random.randrange(30)}"
            texts.append((n, " ".join(words)))
            n += 1
    docs = awkward(spark, texts)
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    want = {}
    for i, a in sets.items():
        links = sum(5 * len(a & b) >= 4 * len(a | b) for j, b in sets.items() if j != i and a and b)
        want[i] = (min([j for j, b in sets.items() if a and a == b], default=i), links)
    rows = jaccard_join.jaccard_links(docs).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None} == want
    assert sum(w[1] for w in want.values()) > 1000
    assert [(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is None] == [(None, None)] * 2
    short = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == short


def groups(table, *keys):
    at = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
    return [table.filter(pa.array([x == g for x in at])) for g in sorted(set(at))]


def counted(tasks, fans):
    """shared_tokens without Spark: the last table, and the rows of each exchange."""
    table, rows = pa.concat_tables([pa.Table.from_batches([j._pack(*t, fans)]) for t in tasks]), []
    steps = [j._route_tokens(fans, k) for k in range(1, len(fans))] + [j._count_bucket(fans)] + [j._route_counts(fans, k) for k in range(1, len(fans))]
    for step in [*steps, j._count_part]:
        rows.append(len(table))
        table = pa.concat_tables([step(t) for t in groups(table, "at", "lot")])
    return table, rows


@pytest.mark.parametrize("fans", [[7], [4, 3], [3, 3, 2]])
def test_shared_tokens_of_parts_equal_a_plain_count(fans):
    """Packed sums after any number of digits, against counting tokens one by one; ids repeat, sets are empty."""
    rng = np.random.default_rng(5)
    docs = [(int(i), np.unique(rng.integers(0, 60, rng.integers(0, 9))).astype(np.uint64)) for i in rng.integers(0, 40, 90)]
    tasks = [([i for i, _ in p], [len(t) for _, t in p], [t for _, t in p]) for p in (docs[:30], docs[30:60], docs[60:])]
    got, _ = counted(tasks, fans)
    times = Counter(t for _, s in docs for t in s.tolist())
    want = {i: (max(len(s) for k, s in docs if k == i), sum(times[t] > 1 for k, s in docs if k == i for t in s.tolist()), sum(k == i for k, _ in docs)) for i, _ in docs}
    got = got.to_pylist()
    assert {r["doc"]: (r["n"], r["shared"], r["rows"]) for r in got} == want and len(got) == len(want)


def test_rows_of_the_count_filter_grow_with_the_documents(monkeypatch):
    """At 4, 8 and 16 times what one digit of buckets holds, no exchange has more than FAN / BUCKET_DOCS rows a document."""
    monkeypatch.setattr(j, "BUCKET_DOCS", 20)
    monkeypatch.setattr(j, "FAN", 8)
    rng, seen = np.random.default_rng(6), {}
    for n in (640, 1280, 2560):
        fans = j.digits(n)
        assert len(fans) > 1 and np.prod(fans) >= n // 20
        docs = [(i, np.unique(rng.integers(0, 10 * n, 40)).astype(np.uint64)) for i in range(n)]
        parts = [docs[a : a + 40] for a in range(0, n, 40)]
        seen[n] = counted([([i for i, _ in p], [len(t) for _, t in p], [t for _, t in p]) for p in parts], fans)[1]
    for n, rows in seen.items():  # the last digit may have a smaller base, so fewer rows
        assert max(rows) <= 1.2 * n * j.FAN / j.BUCKET_DOCS, seen
    assert seen[2560][0] <= 4 * seen[640][0]


def test_links_across_sizes_and_blocks(spark, monkeypatch):
    """Block pairs of other sizes are left out, and no link is: chains of sets that grow, against brute force."""
    monkeypatch.setattr(j, "LINK_BLOCK", 4)
    monkeypatch.setattr(j, "BLOCK", 4)
    monkeypatch.setattr(j, "FEW", 2)
    docs = spark.createDataFrame([(n * 100 + v, " ".join(f"w{i}" for i in range(n)) + f" v{v}") for n in range(6, 120, 3) for v in range(3)], "doc_id long, text string")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    want = {i: sum(5 * len(a & b) >= 4 * len(a | b) for k, b in sets.items() if k != i) for i, a in sets.items()}
    rows = j.jaccard_links(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == want and max(want.values()) > 20
    lone = brute_components({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == lone
