"""Ranking quality against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(topic, rank, uri, grade): a run with its judgements; grade is null for unjudged results."""
    grades = qrels.groupBy("topic", "uri").agg(F.max("grade").alias("grade"))
    return run.select("topic", "rank", "uri").join(grades, ["topic", "uri"], "left")


def topic_scores(run: DataFrame, qrels: DataFrame, k: int = 10, depth: int = 100) -> DataFrame:
    """One row per topic with something relevant to find: precision, recall, reciprocal rank, average precision, nDCG, success.

    Precision, recall, nDCG and success look at the first ``k`` results, the others at ``depth``.
    Topics without a relevant judgement can't be scored and are left out (E8); topics without results score 0.
    """
    graded = qrels.groupBy("topic", "uri").agg(F.max("grade").alias("grade"))
    ideal_order = Window.partitionBy("topic").orderBy(F.desc("grade"), F.asc("uri"))
    gain = lambda g: F.pow(F.lit(2.0), F.least(g, F.lit(31))) - 1
    ideal = graded.where("grade > 0").withColumn("_i", F.row_number().over(ideal_order))
    totals = ideal.groupBy("topic").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("_i") <= k, gain(F.col("grade")) / F.log2(F.col("_i") + 1))).alias("ideal"))
    rows = run.where(F.col("rank") <= depth).select("topic", "rank", "uri").join(graded, ["topic", "uri"], "left").withColumn("_rel", (F.coalesce("grade", F.lit(0)) > 0).cast("int"))
    hits = F.sum("_rel").over(Window.partitionBy("topic").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_k = F.col("rank") <= k
    per = (
        rows.withColumn("_hits", hits)
        .groupBy("topic")
        .agg(
            F.sum(F.when(at_k, F.col("_rel")).otherwise(0)).alias("_found"),
            F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"),
            F.sum(F.when(F.col("_rel") == 1, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("_ap"),
            F.sum(F.when(at_k & (F.col("_rel") == 1), gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
            F.count_if(at_k & F.col("grade").isNull()).alias("_unjudged"),
        )
    )
    zero = F.lit(0.0)
    return totals.join(per, "topic", "left").select(
        "topic",
        F.coalesce(F.col("_found") / F.lit(float(k)), zero).alias("precision") if k else zero.alias("precision"),
        F.coalesce(F.col("_found") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(1 / F.col("_first"), zero).alias("reciprocal_rank"),
        F.coalesce(F.col("_ap") / F.col("relevant"), zero).alias("average_precision"),
        F.coalesce(F.col("_dcg") / F.col("ideal"), zero).alias("ndcg"),
        F.coalesce((F.col("_found") > 0).cast("int"), F.lit(0)).alias("success"),
        F.coalesce("_unjudged", F.lit(0)).cast("long").alias("unjudged"),
    )


def skipped_topics(topics: DataFrame, qrels: DataFrame, topic: str = "topic") -> DataFrame:
    """One row: topics asked for, and those left out because nothing relevant is known for them."""
    known = qrels.where("grade > 0").select("topic").distinct().withColumn("_known", F.lit(True))
    asked = topics.select(F.col(topic).alias("topic")).where("topic is not null").distinct().join(known, "topic", "left")
    return asked.agg(F.count("*").alias("topics"), F.count_if(F.col("_known").isNull()).alias("skipped"))


def summary(scores: DataFrame) -> DataFrame:
    """Means over topics: one row."""
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return scores.agg(
        F.count("*").alias("topics"), mean("precision", "precision"), mean("recall", "recall"), mean("reciprocal_rank", "mrr"), mean("average_precision", "map"), mean("ndcg", "ndcg"),
        mean("success", "success_rate"), F.count_if(F.col("success") == 0).alias("failures"), F.coalesce(F.sum("unjudged"), F.lit(0)).alias("unjudged"),
    )


def tie_groups(run: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """(group, score, members) of scores that several results share."""
    return run.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("members")).where("members > 1")


def tie_report(run: DataFrame, answers: DataFrame, group: str = "qid") -> DataFrame:
    """One row on ties at the answer's score: queries, tied, mean_group, largest, compromised."""
    sizes = run.groupBy(group, "score").agg(F.count("*").alias("members"))
    at = answers.join(sizes, [group, "score"])
    n, tied = F.count("*"), F.count_if(F.col("members") > 1)
    return at.agg(n.alias("queries"), tied.alias("tied"), F.coalesce(F.avg("members"), F.lit(0.0)).alias("mean_group"), F.coalesce(F.max("members"), F.lit(0)).alias("largest"), (tied * 10 > n).alias("compromised"))
