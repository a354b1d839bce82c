"""Link graph and PageRank."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarnsearch.operators.index import dense_ids
from tarnsearch.session import shared_path, write_shared


@dataclass(frozen=True)
class Options:
    damping: float = 0.85
    tolerance: float = 1e-6
    max_iterations: int = 100


@dataclass
class Ranks:
    scores: DataFrame
    iterations: int
    residual: float
    options: Options = Options()

    @property
    def converged(self) -> bool:
        return self.residual < self.options.tolerance

    def ranked(self) -> DataFrame:
        return self.scores.orderBy(F.desc("score"), F.asc("id"))


def edges(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges without self-links."""
    return links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src != dst").distinct()


def nodes(edge_rows: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Sources, targets - crawled or not - and pages without links."""
    ends = edge_rows.select(F.col("src").alias("id")).unionByName(edge_rows.select(F.col("dst").alias("id")))
    if pages is not None:
        ends = ends.unionByName(pages.select(F.col(pages.columns[0]).alias("id")).where("id is not null"))
    return ends.distinct()


def out_degrees(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(id, degree), 0 for dangling nodes."""
    return node_rows.join(edge_rows.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def _numbered(edge_rows: DataFrame, node_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node) with dense numbers, and edges as (src, dst) of those numbers."""
    named = write_shared(dense_ids(node_rows.select("id"), "id", "node"), "graph-names")
    ends = edge_rows.join(named.withColumnsRenamed({"id": "src", "node": "s"}), "src").join(named.withColumnsRenamed({"id": "dst", "node": "d"}), "dst")
    return named, ends.select(F.col("s").alias("src"), F.col("d").alias("dst"))


def pagerank(edge_rows: DataFrame, node_rows: DataFrame, options: Options = Options()) -> Ranks:
    """Power iteration from a uniform start; rank of dangling nodes is spread evenly.

    Edges become pairs of numbers in a table bucketed and sorted by source, so a round moves ranks to the edges
    and never the edges; sums per target are combined before they are shuffled.  A round is one job: residual
    and dangling mass are observed while its ranks are written to the shared folder.
    """
    spark = edge_rows.sparkSession
    named, pairs = _numbered(edge_rows, node_rows)
    n = named.count()
    if not n:
        return Ranks(spark.createDataFrame([], f"id {node_rows.dtypes[0][1]}, score double"), 0, 0.0, options)
    catalogue = f"edges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").option("path", shared_path(spark, "graph-edges")).saveAsTable(catalogue)
    links = spark.table(catalogue)
    try:
        degrees = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
        ranks = write_shared(named.select("node").join(degrees, "node", "left").fillna(0, ["degree"]).withColumn("score", F.lit(1.0 / n)), "ranks")
        dangling = ranks.where("degree = 0").count() / n
        rounds, residual = 0, float("inf")
        while rounds < options.max_iterations and residual >= options.tolerance:
            base = (1 - options.damping) / n + options.damping * dangling / n
            shares = ranks.where("degree > 0").select(F.col("node").alias("src"), (F.col("score") / F.col("degree")).alias("share"))
            received = links.join(shares, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
            score = F.lit(base) + options.damping * F.coalesce("got", F.lit(0.0))
            stepped = ranks.withColumnRenamed("score", "old").join(received, "node", "left").select("node", "degree", score.alias("score"), "old")
            seen = Observation()
            watched = stepped.observe(seen, F.sum(F.abs(F.col("score") - F.col("old"))).alias("r"), F.sum(F.when(F.col("degree") == 0, F.col("score")).otherwise(0.0)).alias("d"))
            ranks = write_shared(watched.drop("old"), "ranks")
            residual, dangling, rounds = seen.get["r"], seen.get["d"], rounds + 1
    finally:
        spark.sql(f"DROP TABLE {catalogue}")
    return Ranks(ranks.join(named, "node").select("id", "score"), rounds, residual, options)


def document_ranks(docs: DataFrame, ranks: DataFrame, uri: str = "uri") -> DataFrame:
    """(doc_id, rank) by URL; pages that are no node have rank 0."""
    return docs.select("doc_id", F.col(uri).alias("id")).join(ranks, "id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("rank"))
