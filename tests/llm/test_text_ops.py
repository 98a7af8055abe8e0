"""Toxicity, mixing, packing, urls, WARC and HTML: round trips, held-out accuracy and edge cases."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import html_text, packing, pfair_mix, queries, toxicity, url_filter, warc_bundles
from quire.plans import scratch
from tests.llm.common import awkward, empty

DATA = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels)
    x = got.join(labels, "doc_id").where("held_out").toPandas()
    assert got.count() == docs.count()
    hit = ((x.predicted == 1) & (x.toxic == 1)).sum()
    assert hit / (x.toxic == 1).sum() > 0.9 and hit / (x.predicted == 1).sum() > 0.8
    crc = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got.select("doc_id").collect()}
    assert all(crc[r["doc_id"]] == r["held_out"] for r in got.select("doc_id", "held_out").collect())


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, x).orderBy("doc_id").toPandas().score for x in (labels, turned))
    assert np.array_equal(a, b)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(awkward(spark), labels).count() == 15
    assert {r["score"] for r in toxicity.score(awkward(spark), none).collect()} == {0.0}
    assert toxicity.drop_toxic(awkward(spark), none).columns == awkward(spark).columns
    assert toxicity.score(empty(spark), labels).count() == 0


def test_pu_risk_ignores_what_both_have():
    """Unlabelled text with a share of hidden positives still gives the marker a positive weight only."""
    rng = np.random.default_rng(0)
    common = [rng.choice(500, 20, replace=False).astype(np.int32) for _ in range(600)]
    positive = [np.unique(np.append(x, 900)).astype(np.int32) for x in common[:150]]
    unlabelled = [np.append(x, 900).astype(np.int32) if i % 5 == 0 else x for i, x in enumerate(common[150:])]
    feature, weight, bias = toxicity.train(positive, unlabelled, 0.2)
    w = dict(zip(feature.tolist(), weight.tolist(), strict=True))
    assert w[900] + bias > 1 and bias < -0.5


@pytest.mark.parametrize("weights", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}])
def test_pfair_meets_every_deadline(spark, weights):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', cast(case when id % 9 < 3 then 0 when id % 9 < 7 then 1 else 2 end as string)) as source")
    got = pfair_mix.pfair_mix(docs, weights, block_docs=4, slots=100).toPandas()
    assert sorted(got.doc_id) == list(range(3000))
    blocks = got.drop_duplicates(["source", "block_no"])
    assert blocks.slot.is_unique and ((blocks.release <= blocks.slot) & (blocks.slot < blocks.deadline)).all()
    counts = got.source.value_counts()
    share = pfair_mix.shares(weights or {s: float(n) ** 0.5 for s, n in counts.items()}, 100)
    upto = min(int(-(-n // 4)) * 100 // share[s] for s, n in counts.items())  # all sources have blocks till then
    order = blocks.sort_values("slot")
    for s, a in share.items():
        done = np.cumsum(order.source.to_numpy() == s)[: upto - 1]
        assert np.abs(done - np.arange(1, len(done) + 1) * a / 100).max() < 1
    assert (blocks.sort_values(["source", "block_no"]).groupby("source").slot.diff().dropna() > 0).all()


def lags(rows, weights):
    """The largest distance of any source from its weight while all sources have blocks, in blocks."""
    blocks = rows.drop_duplicates(["source", "block_no"]).sort_values("slot")
    last = blocks.groupby("source").slot.max().min()  # till here all sources have blocks
    order = blocks[blocks.slot <= last]
    assert order.slot.tolist() == list(range(len(order)))
    t = np.arange(1, len(order) + 1)
    total = sum(weights.values())
    return max(np.abs(np.cumsum(order.source.to_numpy() == s) - t * w / total).max() for s, w in weights.items())


@pytest.mark.parametrize("weights", [{"s0": 1, "s1": 1, "s2": 1}, {"s0": 0.2, "s1": 0.7, "s2": 0.3}, {"s0": 1 / 3, "s1": 0.25, "s2": 2.0}, None])
def test_pfair_holds_the_weights_themselves_through_many_cycles(spark, weights):
    """Against the weights that were asked for, not the rounded ones, over hundreds of short cycles."""
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    got = pfair_mix.pfair_mix(docs, weights, block_docs=2).toPandas()
    assert len(got) == 9000 and lags(got, weights or {s: 1 for s in ("s0", "s1", "s2")}) < 1


def test_pfair_holds_hundreds_of_tiny_sources():
    weights = {f"s{i:03}": 1e-4 for i in range(900)} | {"big": 1.0}
    share = pfair_mix.held(weights)
    assert share == {f"s{i:03}": 1 for i in range(900)} | {"big": 10_000}
    source = np.array([s for s, *_ in pfair_mix.cycle(share)] * 50)
    t = np.arange(1, len(source) + 1)
    for s in ("big", "s000", "s450", "s899"):
        assert np.abs(np.cumsum(source == s) - t * weights[s] / sum(weights.values())).max() < 1


def test_pfair_weights_that_no_short_cycle_holds():
    root = {s: n**0.5 for s, n in (("a", 1000), ("b", 37), ("c", 5))}
    share = pfair_mix.held(root)
    assert sum(share.values()) == pfair_mix.SLOTS
    assert all(abs(share[s] - w / sum(root.values()) * pfair_mix.SLOTS) <= 1 for s, w in root.items())
    assert pfair_mix.held({"a": 1e-9, "b": 1.0})["a"] == 1  # below one part: one part
    assert pfair_mix.held({}) == {} and pfair_mix.held({"a": 0.37}) == {"a": 1}


def test_pfair_edges(spark):
    docs = awkward(spark)
    mixed = pfair_mix.in_mixed_order(docs)
    assert mixed.columns == docs.columns and mixed.count() == docs.count()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert pfair_mix.pfair_mix(empty(spark)).count() == 0


def test_pfair_keeps_one_lane_for_each_source(spark):
    """Many sources, named weights, blocks of one document, and a partition order that is the mixed order."""
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'big', concat('s', id % 600)) as source", "repeat('x', 50) as text")
    got = pfair_mix.pfair_mix(many, {"big": 0.25, "s1": 0.25}, block_docs=1, slots=100).withColumn("p", F.spark_partition_id())
    rows = got.toPandas()
    assert sorted(rows.doc_id) == list(range(3000)) and rows.p.nunique() > 1
    assert rows.slot.is_unique and ((rows.release <= rows.slot) & (rows.slot < rows.deadline)).all()
    ends = rows.groupby("p").slot.agg(["min", "max"])
    assert (ends["min"].to_numpy()[1:] > ends["max"].to_numpy()[:-1]).all()
    first = rows[rows.slot < 20]
    assert abs((first.source == "s1").sum() - 5) <= 1 and abs((first.source == "big").sum() - 5) <= 1


def test_pfair_keeps_repeated_rows_apart(spark):
    docs = spark.range(500).selectExpr("if(id < 300, 7, id) as doc_id", "'t' as text", "'s' as source").union(spark.range(200).selectExpr("cast(null as long)", "'n'", "'s'"))
    got = pfair_mix.pfair_mix(docs, block_docs=4).toPandas()
    assert len(got) == 700 and not got.duplicated(["slot", "in_block"]).any()


def test_pfair_slots_by_a_plain_scheduler(spark):
    """A second scheduler, that looks for the earliest deadline in every slot, gives the same slots."""
    share = {"a": 7, "b": 5, "c": 4, "d": 1, "e": 3}
    length, done, want = 20, dict.fromkeys(share, 0), []
    for now in range(length):
        ready = [(-(-(done[s] + 1) * length // n), s) for s, n in share.items() if done[s] < n and done[s] * length // n <= now]
        _, s = min(ready)
        want.append((s, done[s], now))
        done[s] += 1
    assert [(s, j, at) for s, j, _, _, at in pfair_mix.cycle(share)] == want


def check_packing(rows, docs, tokenizer):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = str(queries.tokenizer_path())
    tokenizer = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 400")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packing(packing.pack(docs, path).collect(), plain, tokenizer)
    check_packing(packing.pack(docs, path, {"src0": 0.5, "src1": 0.01}).collect(), plain, tokenizer)
    odd = [(1, None), (2, ""), (3, "a <|endoftext|> b'll don't x y\x1cz é ́q ÀÉ ΑΣ Σ."), (4, "x" * 9000), (5, "‍﻿ 漢字😀\r\n\ty")]
    table = spark.createDataFrame([(i, t, "s", "q", 1) for i, t in odd], "doc_id long, text string, source string, queue string, n int")
    got = packing.pack(table, path, with_ids=True).collect()
    check_packing(got, odd, tokenizer)
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert packing.pack(awkward(spark), path).count() >= 15 and packing.pack(empty(spark), path).count() == 0


def test_packing_holds_sources_to_their_weights():
    totals = [40_000, 100_000, 260_000]
    layout = packing.Layout(totals, totals)
    held = np.zeros((3, layout.n // 4096 + 20))
    for q, n in enumerate(totals):
        _, _, length, seq, _ = layout.place(np.array([q]), np.array([0]), np.array([n]))
        np.add.at(held[q], seq, length)
    full = layout.n // 4096
    assert (held[:, :full].sum(axis=0) == 4096).all()
    ideal = np.outer(np.array(totals) / layout.n, np.arange(1, full + 1) * 4096)
    assert np.abs(np.cumsum(held[:, :full], axis=1) - ideal).max() <= 3 * packing.GRAIN


def test_nested_queues_hold_every_source_to_its_weight():
    totals, weights = [30_000 + 100 * i for i in range(23)], [200 + 10 * i for i in range(23)]
    layout = packing.Layout(totals, weights, most=4)
    assert len(layout.inner) == 6
    spans, held = defaultdict(list), np.zeros((23, 400))
    for q, n in enumerate(totals):
        cut = np.arange(0, n, 777)
        row, start, length, seq, off = layout.place(np.full(len(cut), q), cut, np.minimum(777, n - cut))
        for r in range(len(cut)):  # every document whole and in order of its tokens
            mine = row == r
            order = np.argsort(start[mine])
            assert (np.cumsum(length[mine][order]) - length[mine][order] == start[mine][order]).all() and length[mine].sum() == min(777, n - cut[r])
        np.add.at(held[q], seq, length)
        for a, b, c in zip(seq.tolist(), off.tolist(), length.tolist(), strict=True):
            spans[a].append((b, c))
    for parts in spans.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    got = held[:, :100].sum(axis=1) / held[:, :100].sum()
    assert np.abs(got - np.array(weights) / sum(weights)).max() < 0.002


def exact_place(totals, weights, q, t):
    """Position of token t of queue q in the stream, in Python's integers."""
    g, steps, total = packing.GRAIN, packing.WINDOW // packing.GRAIN, sum(weights)

    def sent(i, k):
        return min(i * steps * weights[k] // total * g, totals[k])

    i = -(-(t // g + 1) * total // (steps * weights[q])) - 1
    return sum(sent(i, k) for k in range(len(totals))) + sum(sent(i + 1, k) - sent(i, k) for k in range(q)) + t - sent(i, q)


@pytest.mark.parametrize("size", [10**6, 10**10, 10**13])
@pytest.mark.parametrize("tilt", [(1, 1, 1), (0.5, 0.499, 0.001), (0.001, 0.9, 0.099)])
def test_places_are_exact_at_any_size(size, tilt):
    totals = [size, size // 3 + 7, size // 50 + 1]
    share = list(packing.whole_weights(dict(zip("abc", tilt, strict=True))).values())
    layout = packing.Layout(totals, share)
    rng = np.random.default_rng(3)
    seen = set()
    for q, n in enumerate(totals):
        first = np.sort(rng.choice(n - 500, 40)) if n > 500 else np.array([0])
        row, start, length, seq, off = layout.place(np.full(len(first), q), first, np.full(len(first), 400))
        for r, s, k, x, o in zip(*(v.tolist() for v in (row, start, length, seq, off)), strict=True):
            pos = exact_place(totals, share, q, int(first[r]) + s)
            if pos < layout.full:
                assert (x, o) == divmod(pos, 4096)
            assert exact_place(totals, share, q, int(first[r]) + s + k - 1) == pos + k - 1
            seen.add(pos)
    assert len(seen) > 100
    with pytest.raises(OverflowError):
        packing.Layout([1 << 57], [1])


def test_url_rules_and_parts(spark):
    rows = [
        (1, "http://WWW.Example.ORG/es/1"), (2, "https://a.example.org/en/12?x"), (3, "http://x.org#f"), (4, "http://b.com/fr/"), (5, "http://b.com/de/2"),
        (6, None), (7, "no scheme"), (8, "http://host.net?q=://z"), (9, "http://xample.org/"), (10, "://h/p"), (11, "http://notcom/fr/"), (11, ""),
    ]
    pages = spark.createDataFrame([(*r, 1, "w") for r in rows], "page_id long, url string, row int, tokens string")
    texts = spark.createDataFrame([("host sea side sea host",), (None,), ("",)], "text string")
    got = url_filter.judge(pages, texts).collect()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert len(got) == 12 and all(r["verdict"] in ("allow", "block") for r in got)
    assert by[1] == [("www.example.org", "/es/1", "example.org/es/", "block")]
    assert by[2] == [("a.example.org", "/en/12", "example.org/en/1", "block")]
    assert by[3][0][:3] == ("x.org", "", None) and by[9] == [("xample.org", "/", "org/", "allow")]
    assert by[4] == [("b.com", "/fr/", "com/fr/", "allow")] and by[5] == [("b.com", "/de/2", "com/de/", "block")]
    assert by[6][0][:3] == ("", "", None) and by[7][0][:3] == ("", "", None)
    assert by[8][0][:3] == ("host.net", "", None) and by[10][0][:2] == ("h", "/p") and by[11][0][2] is None
    assert url_filter.judge(pages.limit(0), texts).count() == 0


def test_segmentation_takes_the_likeliest_words():
    cost = {w: -math.log(p) for w, p in (("sea", 0.4), ("side", 0.3), ("seas", 0.1), ("ide", 0.001), ("hotel", 0.1))}
    assert url_filter.segment("seasidehotel", cost, 12) == ["sea", "side", "hotel"]
    assert url_filter.segment("seaq", cost, 12) == ["sea", "q"] and url_filter.segment("", cost, 12) == []


def test_url_scores_by_brute_force(spark):
    """All words of all texts count: dynamic programming over every stretch, then naive Bayes, in plain Python."""
    import random
    import re

    random.seed(8)
    words = ["".join(random.choices("abcde", k=random.randrange(2, 6))) for _ in range(60)] + ["abcdefghij" * 4]
    texts = [(" ".join(random.choices(words, k=40)) + " Once-only ABC9de",) for _ in range(30)] + [(None,), ("",)]
    urls = []
    for i in range(120):
        site, tld = "".join(random.choices(words, k=random.randrange(1, 4))), random.choice(("com", "org", "net"))
        urls.append((i, f"http://{site}.{tld}/{random.choice(('fr', 'de', 'en', 'es'))}/{''.join(random.choices(words, k=2))}-{i}.html"))
    urls += [(200, "http://" + "abcdefghij" * 400 + ".net/x"), (None, None), (201, "http://a.b.net/" + "zq" * 1500), (201, "http://" + words[-1] + words[0] + ".net/9876543210123")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = sorted(((r["host"], r["path"], r["words"], round(r["score"], 6)) for r in url_filter.judge(pages, spark.createDataFrame(texts, "text string")).collect()))

    count = defaultdict(int)
    for (t,) in texts:
        for w in re.findall(r"[a-z]+", (t or "").lower()):
            count[w] += 1
    total = sum(count.values())
    cost = {w: math.log(total / n) for w, n in count.items()}

    def split(name):
        best = [(0.0, 0)]
        for j in range(1, len(name) + 1):
            ways = [(best[j - k][0] + cost[name[j - k : j]], j - k) for k in {len(w) for w in cost} if k <= j and name[j - k : j] in cost]
            if name[j - 1] not in cost:
                ways.append((best[j - 1][0] + math.log(total) + 1, j - 1))
            best.append(min(ways, key=lambda x: x[0]))
        out, j = [], len(name)
        while j:
            out.append(name[best[j][1] : j])
            j = best[j][1]
        return out[::-1]

    def tokens(host, path):
        return [
            f"{kind}:#{min(len(x), 9)}" if x[0].isdigit() else f"{kind}:{w}"
            for kind, part in (("h", ".".join(host.split(".")[:-1])), ("p", path.lower()))
            for x in re.findall(r"[0-9]+|[a-z]+", part)
            for w in ([x] if x[0].isdigit() else split(x))
        ]

    rows = url_filter.judge(pages, spark.createDataFrame(texts, "text string")).select("host", "path", "rule", "verdict").collect()
    seen, docs = {"block": defaultdict(int), "allow": defaultdict(int)}, defaultdict(int)
    for r in rows:
        if r["rule"]:
            docs[r["verdict"]] += 1
            for t in tokens(r["host"], r["path"]):
                seen[r["verdict"]][t] += 1
    size = len(set(seen["block"]) | set(seen["allow"])) + 1
    everything = {v: sum(x.values()) for v, x in seen.items()}

    def score(ts):
        return math.log(docs["block"] / docs["allow"]) + sum(
            math.log((seen["block"][t] + 1) / (everything["block"] + size)) - math.log((seen["allow"][t] + 1) / (everything["allow"] + size)) for t in ts
        )

    want = sorted((r["host"], r["path"], " ".join(tokens(r["host"], r["path"])), round(score(tokens(r["host"], r["path"])), 6)) for r in rows)
    assert docs["block"] and docs["allow"]
    assert [(h, p, s) for h, p, _, s in got] == [(h, p, s) for h, p, _, s in want] and [x[2] for x in got] == [x[2] for x in want]


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "x" * 200), (3, "http://b", "x" * 200), (9, "http://c", "x" * 99), (7, "http://d", "x" * 99), (1, None, None), (2, "u", ""), (8, "v\r\nw", "é" * 60), (8, "v", "é" * 60), (None, "n", "x" * 200), (11, "z", "WARC/1.1\r\n\r\n" * 40_000), (12, "z", "WARC/1.1\r\n\r\n" * 40_000)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, frame int, digest string")
    folder = scratch.new_path(spark, "warc")
    index = warc_bundles.write_bundles(pages, folder)
    lost = warc_bundles.Bundle()  # of an attempt that did not succeed
    lost.add(99, warc_bundles.record(99, "u", b"lost", "d", None, False, ""))
    with open(f"{folder.removeprefix('file://')}/part-000000-00000-lost.warc.zst", "wb") as f:
        f.write(lost.data())
    got = warc_bundles.read_bundles(index).collect()
    assert len(got) == len(rows) and 99 not in {r["page_id"] for r in got}
    kinds = defaultdict(list)
    for r in got:
        kinds[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert kinds[3] == [("response", None)] and kinds[5] == [("revisit", 3)] and kinds[None] == [("response", None)]
    assert kinds[7] == kinds[9] == kinds[1] == kinds[2] == [("response", None)]
    assert sorted(kinds[8], key=str) == [("response", None), ("revisit", 8)] and kinds[12] == [("revisit", 11)]
    want = defaultdict(set)
    for i, _, t in rows:
        want[i].add((len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()))
    assert all({(r["payload_bytes"], r["payload_digest"])} <= want[r["page_id"]] for r in got)
    for r in index.collect():  # each record by its own frame
        headers, payload = warc_bundles.parse(warc_bundles.read_record(r["bundle"], r["frame"], r["offset"], r["length"]))
        assert headers.get("X-Page-ID") == (None if r["page_id"] is None else str(r["page_id"]))
        assert headers["WARC-Type"] == "revisit" or hashlib.sha256(payload).hexdigest() == headers["WARC-Payload-Digest"][7:]
    import zstandard

    for path in {r["bundle"] for r in index.collect()}:  # any Zstandard tool reads the whole bundle
        with open(path.removeprefix("file://"), "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert whole.count(b"WARC-Record-ID: ") >= 1
    nothing = scratch.new_path(spark, "warc")
    index = warc_bundles.write_bundles(pages.limit(0), nothing)
    assert index.isEmpty() and warc_bundles.read_bundles(index).isEmpty()


PAGE = """<html><body class="home has-sidebar"><header class="top"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="layout"><main id="content"><div class="post"><h1>Title &amp; more</h1><div class="post-body"><p>First para of the text with <b>bold</b>word.
<p>Second   para<br>line two.</p><div class="ad-slot ad">Buy now</div><script>x("</p>")</script><ul><li>item one<li>item two</ul></div></div>
<section id="comments"><p>Nice post! I really like this one very much, thanks, and I go on at length</p></section></main><aside><p>Side</p></aside></div>
<form><p>Subscribe</p></form><footer>(c)</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("bold", f"b{i}")) for i in range(4)]
    rows += [(10, None, None), (11, "http://h.example/x", ""), (12, "no host", "plain < text & more"), (13, "http://t.example/", "<p>" + "long text " * 30_000), (13, "http://t.example/", "<!-- open <p>x</p>")]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, host int")
    got = html_text.main_text(pages).collect()
    by = defaultdict(list)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        by[r["page_id"]].append(r["text"])
    assert by[2] == ["Title & more\nFirst para of the text with b2word.\nSecond para line two.\nitem one\nitem two"]
    assert by[10] == [""] and by[11] == [""] and by[12] == ["plain < text & more"] and "" in by[13] and len(max(by[13])) == 10 * 30_000 - 1
    assert html_text.main_text(pages.limit(0)).count() == 0


ARTICLE = "<h1>Head</h1><p>A first paragraph of the article that runs on for a while.</p><p>And a second one, no shorter than it.</p>"
WANT = "Head\nA first paragraph of the article that runs on for a while.\nAnd a second one, no shorter than it."


@pytest.mark.parametrize(
    "wrap",
    [
        '<div class="layout has-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<div class="site no-header-search">{}</div>',
        '<div class="ad-free-reading"><main>{}</main></div>', '<article class="post related-no ad-supported">{}</article>',
        '<div class="sidebar"><main>{}</main></div>', '<form><div class="content">{}</div></form>', '<div id="widgets"><div>{}</div></div>',
        '<nav>Home</nav><div class="body">{}</div><div class="comments"><p>A reader writes very much more than there is in the article, on and on and on, and then again.</p></div>',
        '<div class="text">{}</div><div class="related-posts"><article><p>Another article that you may like.</p></article></div><div id="cookie-notice">Cookies</div>',
        '<main><article>{}</article><article class="comment"><p>I do not agree with this at all.</p></article></main>',
    ],
)
def test_class_words_do_not_hide_the_article(wrap):
    page = html_text.Page(f"<html><body>{wrap.format(ARTICLE)}</body></html>")
    assert page.text(None) == WANT


def test_a_vote_overrules_a_page(spark):
    story = "<p>" + "A line of the story, told at some length. " * 3 + "</p>"
    aside = "<p>" + "A long box that stands on this page only. " * 9 + "</p>"
    plain = f'<body><div class="story">{story}</div><div class="extra"><p>Short.</p></div></body>'
    odd = f'<body><div class="story">{story}</div><div class="extra">{aside}</div></body>'
    assert "box" in html_text.Page(odd).text(None)
    pages = spark.createDataFrame([(i, "http://h.example/", plain) for i in range(5)] + [(9, "http://h.example/", odd), (10, "http://other.example/", odd)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got[9] == got[0] and "box" not in got[9] and "box" in got[10]
    tie = [(1, "http://t.example/", f'<body><div class="a">{story}</div></body>'), (2, "http://t.example/", f'<body><div class="b">{story}</div></body>')]
    tied = html_text.main_text(spark.createDataFrame(tie, "page_id long, url string, html string")).collect()
    assert len({r["text"] for r in tied}) == 1 and tied[0]["text"]


def test_reading_a_page_takes_linear_time():
    import time

    cases = ["<a " * 300_000, "<div>" * 50_000 + "x", "<div>x" * 50_000, "<b>" * 20_000 + "<p>y</p>" * 20_000, "<b>" * 20_000 + "</i></a>" * 20_000]
    cases += ["<li>" * 20_000 + "<ul>" + "<b>" * 20_000 + "<li></li>" * 20_000, "<!-- " * 100_000, '<a "' * 100_000, "<script>" * 100_000, "<p class='" * 50_000]
    for case in cases:
        start = time.process_time()
        html_text.Page(case).text(None)
        assert time.process_time() - start < 6, case[:20]


def test_main_text_of_all_pages(spark):
    """On the given pages the article is one element, so a plain reader gives the truth."""
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_pipeline_keeps_what_each_stage_keeps(spark):
    import corpus_pipeline as pipe
    from tests.llm.test_dedup import LOWER, brute_components

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, start = docs.columns, docs.count()
    toxic = {r["doc_id"] for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    for name, stage in pipe.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = scratch.write(stage(spark, docs, sf), name)
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            want = set(before) - toxic
        elif name == "exact_dedup":
            best = {}
            for d, t in before.items():
                best[t.translate(LOWER)] = max(d, best.get(t.translate(LOWER), d))
            want = set(best.values())
        elif name == "near_dedup":
            want = {c for _, c in brute_components(before).values()}
        else:
            want = set(before)
        assert after == want, name
    packed = pipe.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == after and start > len(after)


def words(n, name):
    return " ".join(f"{name}{i}" for i in range(n)) + "."


@pytest.mark.parametrize("attr", ['style="overflow:hidden"', 'title="hidden gems"', 'aria-hidden="false"', 'data-role="banner"', "data-x='id=ads class=sidebar' title=role", 'onclick="this.hidden = true"', 'data-class="comments"'])
def test_what_stands_in_a_value_is_no_attribute(attr):
    page = f'<html><body><div class="intro"><p>{words(60, "a")}</p></div><div {attr}><p>{words(120, "b")}</p></div></body></html>'
    assert words(120, "b") in html_text.Page(page).text(None)
    for plain in ("hidden", "class=sidebar", "role='banner'", "x=1 HIDDEN=''", "/class=ads"):
        page = f"<html><body><div><p>{words(60, 'a')}</p></div><div {plain}><p>{words(40, 'b')}</p></div></body></html>"
        assert html_text.Page(page).text(None) == words(60, "a")


def test_sections_side_by_side_are_one_article():
    page = f'<html><body><div class="page"><section class="one"><p>{words(150, "a")}</p></section><section><h2>Next</h2><p>{words(120, "b")}</p></section></div></body></html>'
    assert html_text.Page(page).text(None) == "\n".join((words(150, "a"), "Next", words(120, "b")))
