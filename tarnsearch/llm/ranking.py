"""Problem 7: one ranking from scores on different scales.

Scores are replaced by their mean ranks within the group (a query), which removes scale and shape.  The
first principal component of the ranks, from a correlation matrix aggregated over all rows, weighs them;
each loading takes the sign of its declared direction (+1: higher is better).  Items are sorted by projection.

A missing or null score ranks below every score of its kind, all missing ones level.  Of repeated
(group, item, kind) rows the highest score counts; rows with a null group or item are left out.  Equal
projections are ordered by item.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.llm.common import small_side
from tarnsearch.session import write_shared

#: Rows of a group that one window task ranks; larger groups are cut at quantiles of the ranked column.
ROWS_PER_TASK = 200_000


def grouped_ranks(df: DataFrame, group: list[str], value: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds ``rank_lo`` (rows of the group with a smaller value, null being smallest), ``ties`` and ``group_rows``.

    Where a group has more than ``rows_per_task`` rows, distinct values are counted first and ranked in ranges
    put together by the counts of the ranges below; nulls need a count and no order.  So neither a group
    holding a third of all rows, nor its nulls, nor a value that many of its rows share is one task's work.
    """
    sizes = write_shared(df.groupBy(*group).agg(F.count("*").alias("group_rows"), F.count_if(F.col(value).isNull()).alias("_nulls")), "group-sizes")
    known = sizes.agg(F.max("group_rows").alias("most"), F.count("*").alias("n"), F.count_if(F.col("group_rows") > rows_per_task).alias("hot")).first()
    most = known["most"] or 0
    if most <= rows_per_task:
        w = Window.partitionBy(*group)
        return df.withColumn("rank_lo", F.rank().over(w.orderBy(F.col(value).asc())) - 1).withColumn("ties", F.count("*").over(Window.partitionBy(*group, value))).withColumn("group_rows", F.count("*").over(w))
    cuts = int(min(10_000, -(-2 * most // rows_per_task)))
    points = [i / cuts for i in range(1, cuts)]
    values = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    hot = sizes.where(F.col("group_rows") > rows_per_task).select(group)
    borders = df.join(small_side(hot, known["hot"]), group, "left_semi").groupBy(*group).agg(F.percentile_approx(value, points, 10_000).alias("_borders"))
    cut = values.join(small_side(borders, known["hot"] * cuts), group, "left").withColumn("_range", F.greatest(F.lit(0), F.coalesce(F.size(F.filter("_borders", lambda b: b < F.col(value))), F.lit(0)))).drop("_borders")
    cut = write_shared(cut, "value-counts")
    counts = cut.groupBy(*group, "_range").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cuts`` rows a group
    offsets = counts.withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_range").orderBy(F.col(value).asc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(offsets, [*group, "_range"]).select(*group, value, (F.col("_below") + F.coalesce(F.sum("_c").over(inside), F.lit(0))).alias("_lo"), "_c")
    both = df.join(ranked, [*group, value], "left").join(small_side(sizes, known["n"]), group)
    return both.withColumn("rank_lo", F.when(F.col(value).isNull(), 0).otherwise(F.col("_lo") + F.col("_nulls"))).withColumn("ties", F.coalesce("_c", "_nulls")).drop("_lo", "_c", "_nulls")


def first_component(ranks: DataFrame, columns: list[str], directions: list[int]) -> tuple[list[float], list[float], list[float]]:
    """Means, deviations and oriented loadings; the matrix is one aggregate row, constant columns load 0."""
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] + [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    aggs += [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(len(columns)) for j in range(i)]
    row = ranks.agg(*aggs).first().asDict()
    k = len(columns)
    sd = [row[f"s{i}"] or 0.0 for i in range(k)]
    matrix = np.eye(k)
    for i in range(k):
        for j in range(i):
            if sd[i] > 1e-12 and sd[j] > 1e-12:
                matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"] / (sd[i] * sd[j])
    _, vectors = np.linalg.eigh(matrix)
    v = vectors[:, -1] * [1.0 if s > 1e-12 else 0.0 for s in sd]
    if not v.any():
        v = np.array(directions, float) / np.sqrt(k)
    v = np.abs(v) * np.sign(directions)  # no score may count against its declared direction
    return [row[f"m{i}"] or 0.0 for i in range(k)], [s or 1.0 for s in sd], [float(x) for x in v]


def combined_scores(scores: DataFrame, group: str, item: str, columns: list[str], directions: list[int] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(group, item, projection) from one row per item with a column per score."""
    directions = directions or [1] * len(columns)
    kinds = F.array(*[F.struct(F.lit(i).alias("_kind"), F.when(~F.isnan(c), F.col(c)).cast("double").alias("_value")) for i, c in enumerate(columns)])
    long = scores.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.inline(kinds))
    ranked = grouped_ranks(long, ["_g", "_kind"], "_value", rows_per_task)
    share = (F.col("rank_lo") + (F.col("ties") + 1) / 2 - 0.5) / F.col("group_rows")
    names = [f"r{i}" for i in range(len(columns))]
    ranks = write_shared(ranked.groupBy("_g", "_i").agg(*[F.max(F.when(F.col("_kind") == i, share)).alias(n) for i, n in enumerate(names)]), "ranks")
    means, sds, loadings = first_component(ranks, names, directions)
    projection = sum((F.col(n) - m) / s * w for n, m, s, w in zip(names, means, sds, loadings))
    return ranks.select(F.col("_g").alias(group), F.col("_i").alias(item), F.round(projection, 9).alias("projection"))


def score_table(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """(qid, doc_id, body, title, anchor, stored): one row per document of a query, missing scores null."""
    kinds = ("body", "title", "anchor")
    per_doc = hits.where("qid is not null and doc_id is not null").groupBy("qid", "doc_id").agg(*[F.max(F.when(F.col("scorer") == k, F.col("score"))).alias(k) for k in kinds])
    ranks = stored.where("doc_id is not null").groupBy("doc_id").agg(F.max("rank").alias("stored"))
    return per_doc.join(ranks, "doc_id", "left").select("qid", "doc_id", *kinds, "stored")


def combined_hits(hits: DataFrame, stored: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(qid, doc_id, projection) of every document that any scorer returned for the query."""
    return combined_scores(write_shared(score_table(hits, stored), "scores"), "qid", "doc_id", ["body", "title", "anchor", "stored"], rows_per_task=rows_per_task)


def head(projected: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The ``k`` first items of each group; partial limits are taken before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc("projection"), F.asc(item))
    return projected.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def full_order(projected: DataFrame, group: str, item: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Position of every item (a number) in its group, 1 first; large groups and long runs of equal projections are cut into ranges."""
    ranked = grouped_ranks(projected.withColumn("_down", -F.col("projection")), [group], "_down", rows_per_task).withColumnRenamed("rank_lo", "_base").drop("ties", "group_rows")
    tied = grouped_ranks(ranked, [group, "_down"], item, rows_per_task)
    return tied.withColumn("position", (F.col("_base") + F.col("rank_lo") + 1).cast("long")).select(group, item, "position", "projection")
