"""A polite crawl as a loop of DataFrame waves over a table of pages.

The "web" is a table (url, html or extracted columns).  Every wave hands out URLs, drops what robots rules
forbid, joins the pages, spools the documents with a running number, and admits the links found.  State is
written per wave; a pointer file that names the wave changes last, so a stopped crawl resumes with exactly
the documents its state claims.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsearch.functions.text import host
from tarnsearch.functions.urls import resolve
from tarnsearch.operators import frontier, robots
from tarnsearch.operators.frontier import Limits
from tarnsearch.operators.index import dense_ids
from tarnsearch.sources.folders import Folder

URL = "url string, depth int, seq long"


@dataclass(frozen=True)
class Pointer:
    wave: int
    handed_out: int
    spooled: int


class Crawl:
    """``folder`` holds state and spool, on any file system the session reads."""

    def __init__(self, spark: SparkSession, folder: str, limits: Limits = Limits(), rules: DataFrame | None = None):
        self.spark, self.folder, self.limits, self.rules = spark, Folder(spark, folder), limits, rules

    def _path(self, *parts: str) -> str:
        return self.folder.path(*parts)

    def pointer(self) -> Pointer | None:
        return Pointer(**json.loads(self.folder.read_text("pointer.json"))) if self.folder.exists("pointer.json") else None

    def _point(self, p: Pointer) -> None:
        self.folder.replace_text("pointer.json", json.dumps(asdict(p)))

    def _save(self, df: DataFrame, kind: str, wave: int) -> DataFrame:
        path = self._path(kind, f"wave={wave}")
        df.write.mode("overwrite").parquet(path)  # what an unfinished wave left is replaced
        return self.spark.read.parquet(path)

    def _all(self, kind: str, upto: int) -> DataFrame:
        return self.spark.read.parquet(*[self._path(kind, f"wave={w}") for w in range(upto + 1)])

    def start(self, seeds: list[str] | DataFrame) -> None:
        """Begin with a list of URLs, in its order, or with a table of them (url), in theirs."""
        if isinstance(seeds, DataFrame):
            rows = dense_ids(seeds.select("url").where("url is not null").distinct(), "url", "seq").select("url", F.lit(0).alias("depth"), "seq")
        else:
            rows = self.spark.createDataFrame([(u, 0, i) for i, u in enumerate(dict.fromkeys(seeds))], URL)
        clean = rows.select(resolve(F.lit("https://seed.invalid/"), F.col("url")).alias("url"), "depth", "seq").where("url is not null")
        seeds_df = clean.groupBy("url").agg(F.min("depth").alias("depth"), F.min("seq").alias("seq"))
        self._save(seeds_df, "queue", 0)
        self._save(seeds_df.select("url"), "seen", 0)
        self._save(seeds_df.select(host(F.col("url")).alias("host")).distinct(), "hosts", 0)
        self._save(self.spark.createDataFrame([], "seq long, doc_id long, uri string, title string, body string, links array<string>, noindex boolean, outcome string"), "spool", 0)
        self._save(self.spark.createDataFrame([], "target string, text string, seq long"), "anchors", 0)
        self._point(Pointer(0, 0, 0))

    def wave(self, pages: DataFrame) -> bool:
        """One wave; False when nothing is left to hand out.  ``pages``: url, title, text, links (href, text), base, noindex, nofollow."""
        p = self.pointer()
        n = p.wave + 1
        done = self._all("spool", p.wave)
        counts = frontier.per_host_counts(done.select(F.col("uri").alias("url")))
        out = self._save(frontier.handed_out(self.spark.read.parquet(self._path("queue", f"wave={p.wave}")), counts, p.handed_out, self.limits), "handed", n)
        if not out.limit(1).count():
            return False
        given = out.withColumn("path", F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1))
        allowed = robots.matched(given, self.rules) if self.rules is not None else given.withColumn("allowed", F.lit(True))
        fetched = allowed.join(pages.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left")
        outcome = F.when(~F.col("allowed"), "disallowed").when(F.col("_url").isNull(), "errors").when(F.coalesce("noindex", F.lit(False)), "skipped").otherwise("indexed")
        order = Window.orderBy("depth", "seq")  # at most the page budget
        rows = fetched.withColumn("outcome", outcome).withColumn("_n", F.row_number().over(order) + F.lit(p.spooled) - 1)
        rows = rows.withColumn("_base", F.coalesce(F.when(F.col("base") != "", resolve(F.col("url"), F.col("base"))), F.col("url")))
        links = F.when((F.col("outcome") == "indexed") & ~F.coalesce("nofollow", F.lit(False)), F.transform("links", lambda x: F.struct(resolve(F.col("_base"), x["href"]).alias("url"), x["text"].alias("text"))))
        rows = rows.withColumn("_links", F.filter(F.coalesce(links, F.array().cast("array<struct<url:string,text:string>>")), lambda x: x["url"].isNotNull()))
        spool = self._save(rows.select(F.col("_n").cast("long").alias("seq"), F.col("seq").alias("doc_id"), F.col("url").alias("uri"), "title", F.col("text").alias("body"), F.col("_links.url").alias("links"), F.coalesce("noindex", F.lit(False)).alias("noindex"), "outcome", "depth", F.col("_links").alias("found")), "spool", n)
        found = spool.select(F.col("seq").alias("parent"), "depth", F.posexplode("found").alias("i", "l")).select(F.col("l.url").alias("url"), (F.col("depth") + 1).alias("depth"), (F.shiftleft("parent", 32) + F.col("i")).alias("seq"), F.col("l.text").alias("text"))
        self._save(found.select(F.col("url").alias("target"), "text", "seq"), "anchors", n)
        seen = self._all("seen", p.wave)
        fresh = frontier.admitted(found.select("url", "depth", "seq"), seen, self._all("hosts", 0), self.limits)
        fresh = self._save(fresh, "fresh", n)
        left = self.spark.read.parquet(self._path("queue", f"wave={p.wave}")).join(out.select("url"), "url", "left_anti")
        self._save(left.unionByName(fresh), "queue", n)
        self._save(fresh.select("url"), "seen", n)
        handed = out.count()
        self._point(Pointer(n, p.handed_out + handed, p.spooled + handed))
        return True

    def run(self, pages: DataFrame, waves: int = 100) -> DataFrame:
        for _ in range(waves):
            if not self.wave(pages):
                break
        return self.documents()

    def spooled(self) -> DataFrame:
        """Exactly the rows the pointer claims; fewer are an error."""
        p = self.pointer()
        rows = self._all("spool", p.wave).where(F.col("seq") < p.spooled)
        if rows.count() < p.spooled:
            raise ValueError("the spool holds fewer documents than the crawl state claims")
        return rows

    def documents(self) -> DataFrame:
        """(doc_id, uri, title, body, anchors, links) of the indexed pages with the texts of all links to them."""
        p = self.pointer()
        anchors = frontier.anchors_by_target(self._all("anchors", p.wave), self.limits.anchors)
        rows = self.spooled().where("outcome = 'indexed'").select(F.col("seq").alias("doc_id"), "uri", "title", "body", "links")
        none = F.array().cast("array<string>")
        return rows.join(anchors.withColumnRenamed("target", "uri"), "uri", "left").select("doc_id", "uri", "title", "body", F.coalesce("anchors", none).alias("anchors"), "links")

    def counters(self) -> DataFrame:
        return frontier.crawl_counters(self.spooled())
