"""Streaming ingestion: every micro-batch becomes a segment, then due merges run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnsearch.sources.segments import Store


def ingest(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str, files_per_trigger: int = 1, **policy) -> StreamingQuery:
    """Read document files as they arrive and flush each batch; a batch that is replayed makes the same segment again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def flush(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(batch)
            store.compact(**policy)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(stream: DataFrame, time: str, text_terms, lateness: str = "14 days", window: str = "1 day") -> DataFrame:
    """Occurrences of terms per window of event time; records later than ``lateness`` are left out."""
    return stream.withWatermark(time, lateness).select(time, F.explode(text_terms).alias("term")).groupBy(F.window(time, window), "term").agg(F.count("*").alias("n"))
