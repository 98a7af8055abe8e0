"""Row-wise operators over streams, as an extension: marks as files arrive, and counts per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.patterns import found_in


def marks_of_stream(documents: DataFrame, patterns: list[str]) -> DataFrame:
    """Stateless: (doc_id, pattern, label) of a stream of (doc_id, text)."""
    each = F.array(*(F.struct(F.lit(p).alias("pattern"), found_in(F.col("text"), p).alias("labels")) for p in patterns))
    return documents.select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.pattern", F.explode("m.labels").alias("label"))


def counts_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Watermarked counts and sums of events (ts, event_type, value) per window and type."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now to Parquet, exactly once per checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
