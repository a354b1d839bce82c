"""Seeded sampling for known-item evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.functions.text import py_terms
from tarnsearch.operators.index import dense_ids
from tarnsearch.operators.query import QUERY_SCHEMA, query_table
from tarnsearch.operators.scoring import Params
from tarnsearch.operators.search import Index, batch_search

_MASK = (1 << 64) - 1
# Fixed values of the public SplitMix64 generator.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


class Rng:
    """SplitMix64: the same seed gives the same draws everywhere."""

    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & _MASK
        z = self.state
        for shift, factor in ((30, MIX_A), (27, MIX_B)):
            z = (z ^ (z >> shift)) * factor & _MASK
        return z ^ (z >> 31)

    def below(self, n: int) -> int:
        return self.next() * n >> 64


def sample(population: int, wanted: int, seed: int) -> list[int]:
    """Distinct numbers below ``population``, ascending; all of them when that many are wanted.

    A sparse Fisher-Yates shuffle of which only the first draws are made; which numbers are drawn for a seed
    is fixed by the published generator and this order of draws.
    """
    rng, moved, out = Rng(seed), {}, []
    if wanted >= population:
        return list(range(population))
    for i in range(wanted):
        j = i + rng.below(population - i)
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return sorted(out)


def span(terms: list[str], size: int, rng: Rng) -> list[str] | None:
    """A run of ``size`` terms; None for shorter texts."""
    if size <= 0 or len(terms) < size:
        return None
    at = rng.below(len(terms) - size + 1)
    return terms[at : at + size]


@dataclass
class KnownItems:
    run: DataFrame
    queries: dict[str, str]
    answers: dict[str, int]
    skipped: int


def known_items(docs: DataFrame, field: str = "body", wanted: int = 200, size: int = 6, seed: int = 1, depth: int = 100, params: Params = Params(), made: Index | None = None) -> KnownItems:
    """Search for spans taken from sampled documents; the document itself is the answer.

    The sample (at most ``wanted`` rows) is drawn by position in the order of doc_id; one generator draws
    documents, a second with the same seed draws spans, for the documents in ascending order.  ``made`` is
    an index of the documents, searched instead of their texts.
    """
    n = docs.count()
    places = sample(n, wanted, seed)[:wanted]
    numbered = dense_ids(docs.select("doc_id", F.col(field).alias("_text")), "doc_id", "_place")
    rows = numbered.where(F.col("_place").isin(places)).select("doc_id", "_text").collect()  # at most ``wanted``
    texts = dict(sorted((r[0], r[1]) for r in rows))
    chosen = list(texts)
    rng, queries, answers, skipped = Rng(seed), {}, {}, 0
    for i in chosen:
        words = span(py_terms(texts.get(i) or ""), size, rng)
        if words is None:
            skipped += 1
            continue
        queries[f"k{i}"], answers[f"k{i}"] = " ".join(words), i
    table = query_table(docs.sparkSession, queries) if queries else docs.sparkSession.createDataFrame([], QUERY_SCHEMA)
    return KnownItems(batch_search(made or docs, table, depth, params), queries, answers, skipped)


def known_item_report(items: KnownItems, k: int = 10) -> DataFrame:
    """One row: queries, skipped, beyond (answer deeper than the run), mrr, ndcg, success_1, success_k."""
    spark = items.run.sparkSession
    answers = spark.createDataFrame(list(items.answers.items()), "qid string, doc_id long")
    found = answers.join(items.run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    zero, r = F.lit(0.0), F.col("rank")
    mean = lambda c, n: F.round(F.coalesce(F.avg(F.coalesce(c, zero)), zero), 6).alias(n)
    return found.agg(
        F.count("*").alias("queries"), F.lit(items.skipped).alias("skipped"), F.count_if(r.isNull()).alias("beyond"), mean(1 / r, "mrr"), mean(F.when(r <= k, 1 / F.log2(r + 1)), "ndcg"),
        mean(F.when(r <= 1, 1.0), "success_1"), mean(F.when(r <= k, 1.0), "success_k"),
    )
