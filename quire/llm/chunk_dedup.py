"""Repeated passages by content-defined chunking.

A gear hash rolls over a text's bytes: h = 2h + gear[byte] in 32 bits, so it depends on the last 32
bytes only. A chunk ends where it is below 2^32 / CUT_ODDS, between LEAST and MOST bytes. Cut points follow the
content: after an insertion the chunks soon fall into step again. Chunks are deduplicated by digest; a
run of chunks that other places have too is a repeated passage, however many documents its chunks were first
seen in. Each chunk's kept copy is the one with the smallest (document, offset).

Only chunks whose digest occurs more than once leave the corpus-wide count; a digest that a third of all
chunks share is added up before the shuffle and looked up in a join that may be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.words import mix, slices
from quire.plans import scratch

CUT_ODDS = 24
LEAST, MOST = 16, 256
REPORT_BYTES = 120
_GEAR = (mix(np.arange(1001, 1001 + 256, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, by doubling the window five times (bytes before the start count as none)."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[k:] = h[:-k]
        h = h + (older << np.uint32(k))
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    out, last = [], 0
    for c in (np.flatnonzero(gear(data) < np.uint32((1 << 32) // CUT_ODDS)) + 1).tolist():
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), *(pa.list_(x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int32())))
    for batch in batches:
        raw = batch.column(0).to_pylist()
        for a, b, data, offs in slices(batch.column(1)):
            out: list[list] = [[], [], [], [], []]
            whole = data.tobytes()
            for i in range(a, b):
                x, y = int(offs[i - a]), int(offs[i - a + 1])
                if raw[i] is None or x == y:
                    continue
                at = cuts(data[x:y])
                low = [0, *at[:-1]]
                digests = b"".join(hashlib.blake2b(whole[x + p : x + q], digest_size=12).digest() for p, q in zip(low, at, strict=True))
                words = np.frombuffer(digests, "<i4").reshape(-1, 3)
                for o, v in zip(out, (raw[i], low, at, np.ascontiguousarray(words[:, :2]).view("<i8").ravel(), words[:, 2]), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc", "low", "high", "d1", "d2"])


def repeated_passages(docs: DataFrame, least_bytes: int = REPORT_BYTES, across: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage and document where it was first seen.

    Columns: doc_id, start_byte, end_byte, n_chunks, first_doc_id, is_first, passage_start, passage_end. Offsets are
    UTF-8 bytes. A passage is a longest run of neighbouring chunks that all occur elsewhere too; runs shorter than
    ``least_bytes`` are left out. It has one row for each stretch whose first copies lie in one document,
    ``first_doc_id``, whose copy stays; rows with is_first are that copy itself. With ``across``, elsewhere is
    another document; without it, another place of the same one counts too. Null and empty texts and rows with a
    null id have no chunks. Rows that repeat one id and text are copies of each other at one place and so are one;
    an empty input gives an empty result.
    """
    made = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _chunks, "doc long, low array<int>, high array<int>, d1 array<long>, d2 array<int>"
    )
    made = scratch.write(made, "chunks")
    rows = made.select("doc", F.explode(F.arrays_zip("low", "high", "d1", "d2")).alias("c")).select("doc", "c.*")
    places = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc", "low")).alias("first"), F.max(F.struct("doc", "low")).alias("last"))
    again = places.where("first.doc != last.doc" if across else "first != last")
    again = scratch.write(again.select("d1", "d2", F.col("first.doc").alias("first_doc"), F.col("first.low").alias("first_low")), "again")
    found = rows.join(again, ["d1", "d2"]).select("doc", "low", "high", "first_doc", "first_low").distinct()
    # Islands: a chunk goes on with the passage if it begins where the last one ended, and with its stretch if
    # the first document is the same.
    order = Window.partitionBy("doc").orderBy("low", "high", "first_doc")
    ends, owner = F.lag("high").over(order), F.lag("first_doc").over(order)
    begins = F.coalesce(ends != F.col("low"), F.lit(True))
    turns = begins | (owner != F.col("first_doc"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = found.withColumn("begins", begins.cast("int")).withColumn("turns", turns.cast("int"))
    runs = runs.withColumn("passage", F.sum("begins").over(upto)).withColumn("stretch", F.sum("turns").over(upto))
    stretches = runs.groupBy("doc", "passage", "stretch").agg(
        F.min("low").alias("start_byte"),
        F.max("high").alias("end_byte"),
        F.count("*").alias("n_chunks"),
        F.min("first_doc").alias("first_doc_id"),
        F.min("first_low").alias("first_byte"),
    )
    whole = Window.partitionBy("doc", "passage")
    stretches = stretches.withColumn("passage_start", F.min("start_byte").over(whole)).withColumn("passage_end", F.max("end_byte").over(whole))
    return stretches.where(F.col("passage_end") - F.col("passage_start") >= least_bytes).select(
        F.col("doc").alias("doc_id"),
        "start_byte",
        "end_byte",
        "n_chunks",
        "first_doc_id",
        ((F.col("doc") == F.col("first_doc_id")) & (F.col("start_byte") == F.col("first_byte"))).alias("is_first"),
        "passage_start",
        "passage_end",
    )
