"""Problem 10: per-document text statistics and which texts are not natural prose.

The statistics are those of ``textstats``.  Gradient-boosted trees are fitted on a bounded sample of at
most about ``fit_rows`` texts with weak labels (clear prose, clear structural junk; unclear texts stay out
of the sample), and their margin is calibrated to a probability on a hand-checked holdout that was not
used in fitting (``HOLDOUT``, kinds of text written for the purpose, and ``ROWS``, texts of a table that the
weak rules mostly leave open).  Every text is scored.

A null text has null statistics and no verdict; an empty one has zeros and is no prose.  Repeated ids are
scored alike (one row each with ``unique_ids=False``); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.common import one_row_per_id
from tarnsearch.llm.holdout import HOLDOUT, ROWS
from tarnsearch.llm.textstats import FEATURES, statistics
from tarnsearch.session import write_shared

PUBLIC = ("word_count", "mean_word_length", "symbol_ratio", "sentence_line_share", "common_word_share")


def common_words(words: DataFrame, most: int = 100_000) -> dict[str, frozenset]:
    """The word lists by language; the table is of fixed size and more than ``most`` rows are refused."""
    rows = words.where("word is not null").select("lang", "word").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    out: dict = {}
    for r in rows:
        out.setdefault(r["lang"] or "", set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in sorted(out.items())}


def text_statistics(docs: DataFrame, words: DataFrame, id_col="doc_id", text_col="text", *, unique_ids=False) -> DataFrame:
    """doc_id and :data:`FEATURES` of every row with a text."""
    common = common_words(words)

    def measure(batches):
        for b in batches:
            rows = [statistics(t, common) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in columns]], names=["doc_id", *FEATURES])

    rows = one_row_per_id(docs, id_col, unique_ids).select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(measure, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def weak_label():
    """1 for structural junk, 0 for prose, null where the rules don't say."""
    c = F.col
    prose = (c("common_word_share") >= 0.15) & (c("function_word_share") >= 0.25) & (c("label_line_share") < 0.5) & (c("letter_ratio") >= 0.85) & (c("distinct_common_words") >= 3) & (c("garbled_share") < 0.005) & (c("distinct_word_share") > 0.02)
    junk = (c("common_word_share") < 0.05) & (c("function_word_share") < 0.2) | (c("label_line_share") > 0.7) | (c("garbled_share") > 0.03) | (c("letter_ratio") < 0.5) | (c("top_word_share") > 0.3) & (c("word_count") >= 20)
    return F.when(c("word_count") < 6, None).when(junk, 1.0).when(prose, 0.0)


def platt(margins: list[float], labels: list[int]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the holdout margins, with smoothed targets."""
    pos, neg = sum(labels), len(labels) - sum(labels)
    target = [(pos + 1) / (pos + 2) if y else 1 / (neg + 2) for y in labels]
    a, b = 1.0, 0.0
    for _ in range(100):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, a * m + b)))) for m in margins]
        g = [sum((q - t) * m for q, t, m in zip(p, target, margins)), sum(q - t for q, t in zip(p, target))]
        w = [max(1e-9, q * (1 - q)) for q in p]
        h00, h01, h11 = sum(x * m * m for x, m in zip(w, margins)) + 1e-6, sum(x * m for x, m in zip(w, margins)), sum(w) + 1e-6
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g[0] - h01 * g[1]) / det, (h00 * g[1] - h01 * g[0]) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def fitted(stats: DataFrame, common: dict[str, frozenset], fit_rows: int, rounds: int, depth: int, seed: int):
    """The trees and their calibration; trees None where the sample has one class only."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = stats.sparkSession
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    labelled = stats.withColumn("label", weak_label()).where("label is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return vectors, None, (1.0, 0.0)
    # half of the sample from each class where there is enough
    # drawn by hash, so the same rows are fitted however the table is partitioned
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1e6
    parts = [labelled.where((F.col("label") == y) & (place < min(1.0, fit_rows / 2 / n))) for y, n in sorted(sizes.items())]
    sample = write_shared(parts[0].unionByName(parts[1]).coalesce(2), "fit-sample")
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, maxBins=64, minInstancesPerNode=8, stepSize=0.2, seed=seed).fit(vectors.transform(sample))
    held = spark.createDataFrame([(int(y), *statistics(t, common)) for y, t in (*HOLDOUT, *ROWS)], "label int, " + ", ".join(f"{f} double" for f in FEATURES))
    scored = model.transform(vectors.transform(held)).select("label", "rawPrediction").collect()
    return vectors, model, platt([r["rawPrediction"][1] for r in scored], [r["label"] for r in scored])


def judged(docs: DataFrame, words: DataFrame, id_col="doc_id", text_col="text", *, fit_rows=12_000, rounds=16, depth=3, seed=5, unique_ids=False) -> DataFrame:
    """(doc_id, word_count, mean_word_length, symbol_ratio, sentence_line_share, common_word_share, junk_probability, is_prose) of every row."""
    from pyspark.ml.functions import vector_to_array

    stats = write_shared(text_statistics(docs, words, id_col, text_col, unique_ids=unique_ids), "text-statistics")
    vectors, model, (slope, offset) = fitted(stats, common_words(words), fit_rows, rounds, depth, seed)
    if model is None:
        scored = stats.withColumn("junk_probability", F.coalesce(weak_label(), F.lit(0.5)))
    else:
        margin = vector_to_array("rawPrediction")[1]
        scored = model.transform(vectors.transform(stats)).withColumn("junk_probability", 1 / (1 + F.exp(-(F.lit(slope) * margin + F.lit(offset)))))
    scored = scored.withColumn("junk_probability", F.when(F.col("word_count") == 0, 1.0).otherwise(F.col("junk_probability")))
    ids = one_row_per_id(docs, id_col, unique_ids).where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"))
    full = scored.select("doc_id", F.col("word_count").cast("long").alias("word_count"), *PUBLIC[1:], "junk_probability").withColumn("is_prose", F.col("junk_probability") < 0.5)
    return full.unionByName(ids, allowMissingColumns=True)
