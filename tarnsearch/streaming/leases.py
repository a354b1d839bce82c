"""Leases per host over a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnsearch.operators.politeness import lease_schedule
from tarnsearch.sources.folders import Folder

BUSY = "host string, free_ms long"


def grant(stream: DataFrame, folder: str, floor_ms: int = 1000) -> StreamingQuery:
    """Grant the requests of each micro-batch by time, after all that came in earlier batches.

    A batch is scheduled like a table, in chunks of time; one number per host goes from batch to batch.
    Leases and state of batch ``n`` lie below ``folder`` under that number, so a batch that is run again
    replaces its own rows and reads the state before it.
    """
    spark = stream.sparkSession
    place = Folder(spark, folder)

    def run(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(place.path("busy", f"batch={n - 1}")) if place.exists("busy", f"batch={n - 1}") else spark.createDataFrame([], BUSY)
        leases = place.path("leases", f"batch={n}")
        lease_schedule(batch, floor_ms, busy=before).write.mode("overwrite").parquet(leases)
        latest = spark.read.parquet(leases).select("host", "free_ms").unionByName(before).groupBy("host").agg(F.max("free_ms").alias("free_ms"))
        latest.write.mode("overwrite").parquet(place.path("busy", f"batch={n}"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", place.path("checkpoint")).trigger(availableNow=True).start()


def granted(spark: SparkSession, folder: str) -> DataFrame:
    """All leases so far."""
    return spark.read.parquet(Folder(spark, folder).path("leases"))
