"""Crawl frontier: admission, hand-out, anchors, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.functions.text import host


@dataclass(frozen=True)
class Limits:
    pages: int = 1000
    depth: int = 3
    per_host: int = 500
    same_host: bool = True
    anchors: int = 32


def admitted(found: DataFrame, seen: DataFrame, seed_hosts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(url, depth, seq): the first sighting of each URL that is neither too deep, nor seen, nor on a foreign host.

    ``found`` has url, depth and seq, an order over all sightings.
    """
    ok = found.where(F.col("url").isNotNull() & (F.col("depth") <= limits.depth))
    if limits.same_host:
        ok = ok.withColumn("_host", host(F.col("url"))).join(seed_hosts.select(F.col("host").alias("_host")).distinct(), "_host", "left_semi").drop("_host")
    first = ok.groupBy("url").agg(F.min(F.struct("depth", "seq")).alias("_f")).select("url", "_f.depth", "_f.seq")
    return first.join(seen.select("url").distinct(), "url", "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows per key by ``order``; the cut is taken within every task before rows move."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def handed_out(queue: DataFrame, fetched_per_host: DataFrame | None, handed: int, limits: Limits = Limits()) -> DataFrame:
    """The URLs to fetch next: per-host cap first, then the page budget; capped hosts don't use up budget."""
    rows = queue.withColumn("host", host(F.col("url")))
    if fetched_per_host is not None:
        rows = rows.join(fetched_per_host.select("host", F.col("pages").alias("_done")), "host", "left")
    else:
        rows = rows.withColumn("_done", F.lit(0))
    # no host can give more than its cap, so the cut before the ranking is exact
    w = Window.partitionBy("host").orderBy("depth", "seq")
    capped = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limits.per_host).where(F.col("_n") + F.coalesce("_done", F.lit(0)) <= limits.per_host)
    return capped.drop("_n", "_done").orderBy("depth", "seq").limit(max(0, limits.pages - handed))


def anchors_by_target(links: DataFrame, most: int = Limits.anchors) -> DataFrame:
    """(target, anchors): the first ``most`` distinct trimmed texts that point at a URL, by ``seq``."""
    texts = links.select(F.col("target"), F.trim("text").alias("text"), "seq").where("target is not null and text <> ''")
    first = texts.groupBy("target", "text").agg(F.min("seq").alias("seq"))
    kept = first_per_key(first, ["target"], ["seq", "text"], most)
    return kept.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("anchors"))


def per_host_counts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    return urls.select(host(F.col(url_col)).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("pages"))


def crawl_counters(outcomes: DataFrame) -> DataFrame:
    """One row: fetched, indexed, disallowed, skipped, errors from an ``outcome`` column."""
    names = ("fetched", "indexed", "disallowed", "skipped", "errors")
    return outcomes.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])
