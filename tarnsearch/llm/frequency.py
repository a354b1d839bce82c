"""Problem 3: total count and document frequency of every term, and which terms are too rare or too common.

Heavy terms are detected on a bounded sample of records (``sample_rows``; only speed depends on it) and
broadcast (at most ``heavy_terms`` words).  Every task counts them in two exact arrays, and the other terms
in a bounded table that is handed on when it is full, so a heavy term costs one row per task in the
shuffle.  Both tables of partial counts leave the same pass and are added up per term.

A null text is no record; an empty one is a record without terms.  Repeated ids count once with
``unique_ids=False``.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.functions.text import py_terms
from tarnsearch.llm.common import one_row_per_id


def detect_heavy(texts: DataFrame, rows: int, sample_rows: int, heavy_terms: int, share: float) -> list[str]:
    """Terms in at least ``share`` of a sample of about ``sample_rows`` records, the most frequent first."""
    fraction = min(1.0, sample_rows / max(1, rows))

    def words(batches):
        for b in batches:
            seen: Counter = Counter()
            for t in b.column(0).to_pylist():
                seen.update(set(py_terms(t)))
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    sample = texts.sample(False, fraction, 7) if fraction < 1 else texts
    found = sample.mapInArrow(words, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, share * min(rows, sample_rows)))
    return [r["term"] for r in found.orderBy(F.desc("n"), "term").limit(heavy_terms).collect()]


def _counter(heavy: list[str], table_size: int):
    def count(batches):
        import numpy as np

        place = {t: i for i, t in enumerate(heavy)}
        total, docs = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        rest_total: Counter = Counter()
        rest_docs: Counter = Counter()

        def rest():
            keys = list(rest_total)
            out = pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "n": pa.array([rest_total[k] for k in keys], pa.int64()), "d": pa.array([rest_docs[k] for k in keys], pa.int64())})
            rest_total.clear()
            rest_docs.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                for term, n in Counter(py_terms(text)).items():
                    i = place.get(term)
                    if i is None:
                        rest_total[term] += n
                        rest_docs[term] += 1
                    else:
                        total[i] += n
                        docs[i] += 1
                if len(rest_total) > table_size:
                    yield rest()
        if rest_total:
            yield rest()
        used = np.nonzero(docs)[0]
        if len(used):
            yield pa.RecordBatch.from_pydict({"term": pa.array([heavy[i] for i in used], pa.string()), "n": pa.array(total[used]), "d": pa.array(docs[used])})

    return count


def term_frequencies(docs: DataFrame, id_col="doc_id", text_col="body", *, rare_docs=2, common_share=0.67, sample_rows=4000, heavy_terms=4096, heavy_share=0.01, table_size=200_000, unique_ids=False) -> DataFrame:
    """(term, total_count, doc_freq, mark): mark is ``rare`` up to ``rare_docs`` records, ``common`` above ``common_share`` of them, else null."""
    texts = one_row_per_id(docs, id_col, unique_ids).select(F.col(text_col).alias("_text")).where("_text is not null")
    rows = texts.count()
    heavy = detect_heavy(texts, rows, sample_rows, heavy_terms, heavy_share)
    partial = texts.mapInArrow(_counter(heavy, table_size), "term string, n long, d long")
    counts = partial.groupBy("term").agg(F.sum("n").alias("total_count"), F.sum("d").alias("doc_freq"))
    mark = F.when(F.col("doc_freq") <= rare_docs, "rare").when(F.col("doc_freq") > F.lit(common_share) * rows, "common")
    return counts.withColumn("mark", mark)


def latest_reports(stats: DataFrame) -> DataFrame:
    """(term, reported_docs): document frequencies summed over the latest report of each shard and term; null counts are no report."""
    latest = stats.where("doc_freq is not null").groupBy("shard", "term").agg(F.max(F.struct("reported_at", "doc_freq"))["doc_freq"].alias("doc_freq"))
    return latest.groupBy("term").agg(F.sum("doc_freq").alias("reported_docs"))


def frequencies_with_reports(docs: DataFrame, stats: DataFrame, **options) -> DataFrame:
    """:func:`term_frequencies` with the shards' summed document frequency and whether both agree (null: not reported)."""
    counts = term_frequencies(docs, **options)
    return counts.join(latest_reports(stats), "term", "left").withColumn("agrees", F.col("doc_freq") == F.col("reported_docs"))
