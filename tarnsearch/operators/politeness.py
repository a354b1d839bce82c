"""Fetch leases per host."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lease_schedule(requests: DataFrame, floor_ms: int = 1000, chunk_ms: int = 86_400_000, busy: DataFrame | None = None) -> DataFrame:
    """(host, t, requested_ms, permits, arrived_at, wait_ms, free_ms): when each request may start and when the host is free again.

    A request starts at the later of its time and the end of the one before; it takes its spacing (at
    least ``floor_ms``) for each permit.  With costs added up to ``S`` before a request, its slot is
    ``S + max(t - S)`` over the requests so far.  Sum and maximum are prefixes, so a host is cut into
    chunks of time: chunk totals are added up first, and a hot host is many window partitions.

    ``busy`` (host, free_ms) says until when a host is taken by requests that came before all of these.
    Repeated rows are one request; rows without host or time are left out; hosts are compared in lower case.
    """
    known = requests.where("host is not null and t is not null").withColumn("host", F.lower("host")).distinct()
    ms = F.unix_millis(F.col("t").cast("timestamp"))
    spacing = F.greatest(F.coalesce(F.col("requested_ms"), F.lit(0)), F.lit(floor_ms))
    rows = known.withColumn("_t", ms).withColumn("_cost", spacing * F.coalesce(F.col("permits"), F.lit(1))).withColumn("_chunk", F.floor(F.col("_t") / chunk_ms))
    order = ["_t", "requested_ms", "permits", "arrived_at"]
    inside = Window.partitionBy("host", "_chunk").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # chunk tables: one row per host and chunk
    earlier = Window.partitionBy("host").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("host", "_chunk").agg(F.sum("_cost").alias("_sum"))
    offsets = totals.select("host", "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    local = rows.join(offsets, ["host", "_chunk"]).withColumn("_s", F.col("_before") + F.sum("_cost").over(so_far) - F.col("_cost"))
    peaks = local.groupBy("host", "_chunk").agg(F.max(F.col("_t") - F.col("_s")).alias("_peak"))
    carried = peaks.select("host", "_chunk", F.max("_peak").over(earlier).alias("_carried"))
    if busy is not None:
        carried = carried.join(busy.select("host", F.col("free_ms").alias("_free")), "host", "left").select("host", "_chunk", F.greatest("_carried", "_free").alias("_carried"))
    slot = F.col("_s") + F.greatest(F.max(F.col("_t") - F.col("_s")).over(so_far), F.col("_carried"))
    done = local.join(carried, ["host", "_chunk"]).withColumn("_slot", slot)
    return done.select("host", "t", "requested_ms", "permits", "arrived_at", (F.col("_slot") - F.col("_t")).alias("wait_ms"), (F.col("_slot") + F.col("_cost")).alias("free_ms"))


def without_authority(requests: DataFrame) -> DataFrame:
    """(host, t, permits, wait_ms, spacing_ms) where nobody grants leases (C9): permission at once, at the spacing that was asked for."""
    known = requests.where("host is not null and t is not null").distinct()
    permits = F.greatest(F.coalesce("permits", F.lit(1)), F.lit(1))
    return known.select(F.lower("host").alias("host"), "t", permits.alias("permits"), F.lit(0).cast("long").alias("wait_ms"), F.coalesce("requested_ms", F.lit(0)).cast("long").alias("spacing_ms"))
