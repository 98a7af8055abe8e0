"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, text of unknown kind is the unlabelled rest. No document counts as
negative because its label says so; labels of clean documents enter the class prior only, which is the mean of
the labels that may be learnt from. With class prior pi the risk of a classifier g is

    R = pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

where the second term estimates the risk on negatives; when it turns negative the step is taken
against it instead. Several numpy classifiers, each on its own share of the unlabelled sample, are
trained in Spark tasks; a document's logit is their mean. Features are a text's distinct words and word
beginnings of 4 to 6 bytes, and apart from them those that it has twice or more, hashed; each classifier keeps those that are frequent among positives and
rare among negatives, whose frequency follows from the same correction, (u - pi * p) / (1 - pi).

Bounds: at most MOST_POSITIVE positives and MOST_UNLABELLED unlabelled documents are sampled (those with
the smallest hash of their id); whole texts of all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.words import Words, mix, slices
from quire.plans import scratch
from quire.plans.joins import without

BITS = 20
MOST_POSITIVE = 2000
MOST_UNLABELLED = 6000
MEMBERS = 3
FEATURES = 2000
LEAST_SEEN = 5
LEAST_LIFT = 4
COVER = 4
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_features(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each feature, feature) by slices of texts; a text may repeat a feature."""
    keep = np.uint64((1 << BITS) - 1)
    for a, b, data, offs in slices(text):
        w = Words(data, offs)
        row = np.repeat(np.arange(b - a), np.diff(w.first))
        rows, found = [row], [w.hash & keep]
        for k in (4, 5, 6):
            long = w.end - w.start >= k
            at = w.start[long]
            rows.append(row[long])
            found.append(mix(w.span(at, at + k) + np.uint64(k)) & keep)
        yield a, np.concatenate(rows), np.concatenate(found).astype(np.int64)


def twice(feature: np.ndarray) -> np.ndarray:
    """The feature of having ``feature`` twice or more."""
    return (mix(feature.astype(np.uint64) + np.uint64(0x7F4A7C15)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def by_row(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), sorted, with the features of those that come twice or more."""
    key, n = np.unique((row.astype(np.int64) << BITS) | feature, return_counts=True)
    again = key[n > 1]
    low = (1 << BITS) - 1
    key = np.unique(np.concatenate((key, (again & ~low) | twice(again & low))))
    return key >> BITS, key & low


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, positive, features) of the sampled documents."""
    for batch in batches:
        out = [b""] * batch.num_rows
        for a, row, feature in text_features(batch.column(2)):
            row, feature = by_row(row, feature)
            at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
            for x, y in zip(at, [*at[1:], len(row)], strict=True):
                out[a + int(row[x])] = feature[x:y].astype(np.int32).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["member", "positive", "features"])


def cover(positive: list[np.ndarray], features: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Features chosen one by one for the positives that COVER chosen ones do not mark yet.

    Copies of a positive share all its words; once its telling ones are chosen, the rest add nothing.
    """
    slot = np.full(1 << BITS, -1, np.int32)
    slot[features] = np.arange(len(features))
    sets = [x[x >= 0] for x in (slot[y] for y in positive)]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    col = np.concatenate([np.zeros(0, np.int32), *sets])
    order = np.argsort(col, kind="stable")
    rows_of = np.split(row[order], np.searchsorted(col[order], np.arange(1, len(features)))) if len(features) else []
    marked, left, chosen = np.zeros(len(sets), int), np.bincount(col, minlength=len(features)), []
    while len(chosen) < FEATURES and len(features):
        gain = np.where(left >= LEAST_SEEN, left * lift[features], 0)
        j = int(np.argmax(gain))
        if gain[j] <= 0:
            break
        chosen.append(features[j])
        marked[rows_of[j]] += 1
        done = rows_of[j][marked[rows_of[j]] == COVER]
        left[j] = 0
        for r in done:
            np.subtract.at(left, sets[r], 1)
    return np.sort(np.array(chosen, np.int64))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of one non-negative PU classifier with logistic loss."""
    size = 1 << BITS

    def count(sets):
        total = np.zeros(size, np.int32)
        for x in sets:  # a set has each feature once
            total[x] += 1
        return total

    n_p, n_u = len(positive), len(unlabelled)
    p, u = count(positive) / max(1, n_p), count(unlabelled) / max(1, n_u)
    n = np.maximum(0, u - prior * p) / (1 - prior)  # frequency among negatives
    noise = 2 * np.sqrt(n / max(1, n_u)) + 3 / max(1, n_u)
    least = p - 2 * np.sqrt(p / max(1, n_p))
    clear = (p * n_p >= LEAST_SEEN) & (least >= LEAST_LIFT * (n + noise))
    best = cover(positive, np.flatnonzero(clear), np.log((p + 1e-9) / (n + noise)))
    slot = np.full(size, -1, np.int32)
    slot[best] = np.arange(len(best))
    sets = [x[x >= 0] for x in (slot[y] for y in (*positive, *unlabelled))]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    col = np.concatenate([np.zeros(0, np.int32), *sets])
    w, bias = np.zeros(len(best)), np.log(prior / (1 - prior)) / 2
    m, v = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(sets)) + bias
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_neg = np.logaddexp(0, z)  # loss of calling a document negative
        negative = loss_neg[n_p:].mean() - prior * loss_neg[:n_p].mean()
        g_pos = np.zeros(len(sets))
        g_pos[:n_p] = prior * (s[:n_p] - 1) / n_p
        g_neg = np.concatenate((-prior * s[:n_p] / n_p, s[n_p:] / n_u))
        g = g_pos + g_neg if negative >= 0 else -g_neg
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(best)) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return best, w, float(bias)


def _train_group(prior: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.int32) for x in rows["features"]]
        yes = rows["positive"].to_numpy()
        # The same order whatever order the rows come in, up to equal sets.
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i].sum(dtype=np.int64)), int((sets[i].astype(np.int64) % 8191 * 31 % 127).sum())))
        feature, weight, bias = train([sets[i] for i in order if yes[i]], [sets[i] for i in order if not yes[i]], prior)
        return pd.DataFrame({"feature": np.append(feature, -1).astype(np.int32), "weight": np.append(weight, bias)})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float] | None:
    """Mean (weights by feature, bias) of the classifiers; None without a confirmed toxic document."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = ids.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    by = F.xxhash64("id", F.lit(7))
    positive = known.where("toxic = 1").join(ids.select("id"), "id", "left_semi").orderBy(by).limit(MOST_POSITIVE)
    positive = scratch.write(positive.select("id"), "positive")
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("x")).first()["x"]
    if positive.isEmpty() or not share:
        return None
    rest = ids.select("id").distinct().orderBy(by).limit(MOST_UNLABELLED)
    rest = scratch.write(rest, "unlabelled")
    if rest.isEmpty():
        return None
    member = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(MEMBERS)).cast("int")
    chosen = positive.select("id", F.lit(True).alias("positive"), F.explode(F.lit(list(range(MEMBERS)))).alias("member")).union(
        rest.select("id", F.lit(False), member)
    )
    sparse = (
        ids.join(F.broadcast(chosen), "id")  # at most MEMBERS * MOST_POSITIVE + MOST_UNLABELLED rows
        .select("member", "positive", "text")
        .mapInArrow(_sparse, "member int, positive boolean, features binary")
    )
    prior = min(max(float(share), 1e-3), 0.9)
    found = sparse.groupBy("member").applyInPandas(_train_group(prior), "feature int, weight double").collect()
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for r in found:  # at most MEMBERS * (FEATURES + 1) rows
        if r["feature"] < 0:
            bias += r["weight"] / MEMBERS
        else:
            weights[r["feature"]] += r["weight"] / MEMBERS
    return weights, bias


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        known = (weights != 0) | (weights[twice(np.arange(1 << BITS))] != 0)
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for a, row, feature in text_features(batch.column(1)):
                hit = known[feature]
                row, feature = by_row(row[hit], feature[hit])
                np.add.at(z, a + row, weights[feature].astype(float))
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the columns named in ``keep``.

    Null texts are empty; a text without words gets the bias alone. Without a confirmed toxic document
    among the rows to learn from, every score is 0. Rows with a null id are scored and count as not
    held out. Repeated rows get equal scores. ``labels`` may repeat an id: toxic once is toxic. An
    empty input gives an empty result.
    """
    kept = keep or []
    rows = docs.select(
        F.struct(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(kept))).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    scratch.bound_arrow(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        scored = rows.select("row", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB at any input size
        kind = rows.schema["row"].dataType.simpleString()
        scored = rows.mapInArrow(_scores(shared), f"row {kind}, score double")
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        *(F.col(f"row.k{i}").alias(c) for i, c in enumerate(kept)),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    keyed = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    flagged = score(keyed, labels, "i", "t", ["h"]).where("predicted = 1").select("doc_id", "h")
    flagged = scratch.write(flagged.distinct(), "toxic")
    return without(docs, [F.col(id_col).cast("long"), F.xxhash64(text_col)], flagged, flagged.count())
