"""The document model over the driver's tables: lines, pages, versions, references, positioned words.

A document is rows: doc_id, page_no and line_no are columns, and nothing relies on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_PER_PAGE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, line_no, text): one row per line of a document, ten lines to a page."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return split.select(
        "doc_id",
        (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("int").alias("page_no"),
        (F.col("pos") + 1).alias("line_no"),
        "text",
    )


def documents_with_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_pages) without exploding a line."""
    sized = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    return sized.withColumn("n_pages", F.ceil(F.col("n_lines") / LINES_PER_PAGE).cast("int"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, n_pages, n_lines of the page)."""
    d = documents_with_pages(spark, sf_dir)
    return d.select("doc_id", "n_pages", "n_lines", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page_no")).select(
        "doc_id",
        "page_no",
        "n_pages",
        F.least(F.lit(LINES_PER_PAGE), F.col("n_lines") - (F.col("page_no") - 1) * LINES_PER_PAGE).alias("page_lines"),
    )


def new_version(old: DataFrame) -> DataFrame:
    """A second version of ``lines``: line 3 of each fifth document goes, each seventh gets a line at its end."""
    kept = old.where(~((F.col("doc_id") % 5 == 0) & (F.col("line_no") == 3)))
    order = kept.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    added = order.where(F.col("doc_id") % 7 == 0).select(
        "doc_id",
        (F.floor(F.col("last") / LINES_PER_PAGE) + 1).cast("int").alias("page_no"),
        (F.col("last") + 1).cast("int").alias("line_no"),
        F.lit("appended line").alias("text"),
    )
    return kept.unionByName(added)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) of an object graph: order -> customer -> nation -> region."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return o.unionByName(c).unionByName(n)


def positioned_words(spark: SparkSession, sf_dir: str, page_rows: int | None = None) -> DataFrame:
    """Words of printed part lists, a page per brand or per ``page_rows`` rows of one: (page, text, x0, y0, x1, y1)."""
    part = table(spark, sf_dir, "part").select(
        "p_brand",
        F.row_number().over(_brand_order()).alias("row"),
        F.array(
            F.struct(F.lit(36.0).alias("x"), F.col("p_partkey").cast("string").alias("w")),
            F.struct(F.lit(120.0).alias("x"), F.element_at(F.split("p_name", " "), 1).alias("w")),
            F.struct(F.lit(260.0).alias("x"), F.col("p_size").cast("string").alias("w")),
        ).alias("cells"),
    )
    page = F.col("p_brand")
    if page_rows:
        page = F.concat(page, F.lit("/"), F.floor((F.col("row") - 1) / page_rows).cast("string"))
    return part.select("p_brand", "row", F.explode("cells").alias("c")).select(
        page.alias("page"),
        F.col("c.w").alias("text"),
        F.col("c.x").alias("x0"),
        (F.col("row") * 14.0).alias("y0"),
        (F.col("c.x") + F.char_length("c.w") * 5.0).alias("x1"),
        (F.col("row") * 14.0 + 10.7).alias("y1"),
    )


def _brand_order():
    from pyspark.sql.window import Window

    return Window.partitionBy("p_brand").orderBy("p_partkey")
