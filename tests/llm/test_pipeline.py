"""The pipeline's stages work on what the stages before them decided."""

import corpus_pipeline as pipe
from quire.llm import exact_dedup, jaccard_join
from tests.llm.common import awkward


def window_shares(spark, docs):
    """Each source's part of the tokens of the first 20 windows."""
    mixed = pipe.mixing(spark, docs, "")
    rows = pipe.packing(spark, mixed, "").where("sequence_id < 20").join(docs.select("doc_id", "source"), "doc_id")
    got = {r["source"]: r["n"] for r in rows.groupBy("source").agg({"length": "sum"}).toDF("source", "n").collect()}
    return {s: n / (20 * 4096) for s, n in got.items()}


def test_mixing_weights_set_the_windows_proportions(spark, monkeypatch):
    # s0 has a third of the rows, s1 to s8 a twelfth each.
    docs = spark.range(2400).selectExpr(
        "id as doc_id", "repeat(concat('some words of text ', id, ' '), 40) as text", "concat('s', if(id % 3 = 0, 0, 1 + id div 3 % 8)) as source"
    )
    own = window_shares(spark, docs)
    root = {"s0": 800**0.5} | {f"s{i}": 200**0.5 for i in range(1, 9)}
    assert all(abs(own[s] - w / sum(root.values())) < 0.01 for s, w in root.items())
    monkeypatch.setattr(pipe, "MIXTURE", {"weights": {"s0": 0.1, "s1": 0.5}})
    turned = window_shares(spark, docs)
    assert abs(turned["s0"] - 0.1) < 0.01 and abs(turned["s1"] - 0.5) < 0.01
    assert all(abs(turned[f"s{i}"] - 0.4 / 7) < 0.01 for i in range(2, 9))


def pairs(docs):
    return sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)


#: Texts of their own under ids that are null or have another text too.
OWN = [(None, "a text that no other row has at all"), (None, "one more that stands alone in the table"), (1, "another text under the first id of all"), (9, "short")]


def test_exact_dedup_keeps_texts_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "A"), (9, "a"), (5, "B"), (9, "A"), (None, "a"), (None, "C"), (7, "b")], "doc_id long, text string")
    got = pairs(exact_dedup.drop_copies(docs))
    assert [(i, t.lower()) for i, t in got] == [(7, "b"), (9, "a"), (None, "c")]
    docs = spark.createDataFrame([(5, "A"), (9, "A"), (5, "B")], "doc_id long, text string")
    assert pairs(exact_dedup.drop_copies(docs)) == [(5, "B"), (9, "A")]
    docs = awkward(spark, OWN)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and set(OWN) <= set(pairs(left))


def test_near_dedup_joins_each_text_of_an_id(spark):
    def text(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(3, text("a")), (3, text("b")), (4, text("a") + " x"), (5, text("b") + " x"), (6, text("b") + " y"), (6, text("c")), (7, text("d")), (7, text("d") + " x")]
    docs = spark.createDataFrame(rows + [(None, text("a"))], "doc_id long, text string")
    left = pairs(jaccard_join.one_of_each(docs))
    assert [x for x in left if x[0] != 7] == sorted([rows[0], rows[1], rows[5], (None, text("a"))], key=str)
    assert len([x for x in left if x[0] == 7]) == 1
    docs = awkward(spark, OWN)
    assert set(OWN) <= set(pairs(jaccard_join.one_of_each(docs)))
