"""Chunking as a stream: new document files in, chunk tables out.

Fixed windows need no state: a document unfolds where it lies.  A micro batch is
written once by its id, so a batch that is replayed replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as T
from textloom.operators import sections, windows


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_batch: int = 100) -> DataFrame:
    """New Parquet files below ``path`` as normalised documents."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("text", T.normalized(F.col("text")))


def write_windows(docs: DataFrame, out: str, checkpoint: str, size: int, overlap: int, available_now: bool = True) -> StreamingQuery:
    """Fixed windows of a stream, appended exactly once."""
    rows = windows.fixed_windows(docs, size, overlap).drop("text")
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_structure(docs: DataFrame, out: str, checkpoint: str, min_tokens: int, max_tokens: int, available_now: bool = True) -> StreamingQuery:
    """Structure chunks of a stream: windows over a document's lines run inside each micro batch."""

    def save(batch: DataFrame, number: int) -> None:
        sections.structure_chunks(batch, min_tokens, max_tokens).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_rates(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "60 seconds") -> DataFrame:
    """Requests and tokens per tumbling minute of a stream, late rows up to the watermark included."""
    rows = events.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
