"""The registered queries of the pipeline operations, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chunk_dedup import repeated_passages
from quire.llm.exact_dedup import content_sort
from quire.llm.fingerprint import imatch
from quire.llm.html_text import main_text
from quire.llm.jaccard_join import jaccard_links
from quire.llm.links_sql import JACCARD_SQL, NEAR_SQL
from quire.llm.merkle import manifest
from quire.llm.merkle_sql import merkle_sql
from quire.llm.minhash import near_components
from quire.llm.packing import pack
from quire.llm.pfair_mix import pfair_mix, target_weights
from quire.llm.token_align import align
from quire.llm.toxicity import score
from quire.llm.url_filter import judge
from quire.llm.warc_bundles import read_bundles, write_bundles
from quire.plans import scratch

TOKENIZER = "word_bpe_49k.json"
ALIGNED_TOKENIZERS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(_table(spark, sf_dir, "documents"))


def op1_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(_table(spark, sf_dir, "pages"), scratch.new_path(spark, "warc"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(_table(spark, sf_dir, "documents"))


def op5_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), across=False)


def op7_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(_table(spark, sf_dir, "documents"))


def op10_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pack(docs, str(tokenizer_path()), target_weights(docs))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(_table(spark, sf_dir, "documents"), *(public_tokenizers.path(x) for x in ALIGNED_TOKENIZERS))


def op13_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_host_words": op1_host_words,
    "op2_nnpu_toxicity": op2_nnpu_toxicity,
    "op3_imatch": op3_imatch,
    "op4_warc_bundles": op4_warc_bundles,
    "op5_gear_chunks": op5_gear_chunks,
    "op6_content_sort": op6_content_sort,
    "op7_host_paths": op7_host_paths,
    "op8_pfair_mix": op8_pfair_mix,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_drr_packing": op10_drr_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_align": op12_token_align,
    "op13_tensored_minhash": op13_tensored_minhash,
}

ORACLE_SQL = {
    "op9_jaccard_join": JACCARD_SQL,
    "op11_merkle_manifest": merkle_sql(),
    "op13_tensored_minhash": NEAR_SQL,
    "op4_warc_bundles": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
            FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM f
    """,
    "op6_content_sort": """
        WITH n AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
        FROM n WINDOW w AS (PARTITION BY s)
    """,
}
