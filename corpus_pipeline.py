"""The corpus pipeline: toxicity, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame; the caller writes it as Parquet and reads it again for the next stage. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.exact_dedup import drop_copies
from quire.llm.jaccard_join import one_of_each
from quire.llm.packing import pack
from quire.llm.pfair_mix import in_mixed_order, target_weights
from quire.llm.queries import tokenizer_path
from quire.llm.toxicity import drop_toxic
from quire.plans import scratch

#: The mixture (``weights`` and ``temperature`` of pfair_mix) that mixing and packing hold sources to.
MIXTURE: dict = {}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic by a classifier learnt from this input and ``labels``."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, keep the one with the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest doc_id, of each component of 5-word Jaccard links of 0.8 or more."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring all documents into the Pfair order of their sources' target weights."""
    return in_mixed_order(docs, **MIXTURE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens by mixing's target weights, one row per piece."""
    return pack(docs, str(tokenizer_path()), target_weights(docs, **MIXTURE))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express the trained classifier, the schedule or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
