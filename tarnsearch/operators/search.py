"""Ranked search for many queries at once.

An :class:`Index` is built once and searched many times.  Only postings of terms that some query names are
read; lengths travel with them, so no join to the documents is needed for scoring.  Queries meet the documents
in :mod:`matching`.  Shards are a column: one pass answers for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.operators import index, matching
from tarnsearch.operators.query import parse, query_table
from tarnsearch.operators.scoring import Params, authority, idf, length_norm, saturation
from tarnsearch.session import write_shared

#: Query terms up to which the term filter is broadcast (rows of a term and two numbers).
BROADCAST_TERMS = 500_000
#: Query terms up to which they are literal values that Parquet filters by row group and page.
LITERAL_TERMS = 1_000
#: Postings that one task matches with the queries.
TASK_POSTINGS = 1_000_000
#: Digits to which scores are rounded before they are ordered, so that equal documents tie.
SCORE_DIGITS = 9


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


@dataclass(frozen=True)
class Index:
    """``postings`` (index.POSTING), ``stored`` (doc_id, uri, length) and ``ranks`` (doc_id, rank), or None.

    ``kept`` tells whether the postings lie in files; otherwise they are made anew from the texts.
    """

    postings: DataFrame
    stored: DataFrame
    ranks: DataFrame | None = None
    kept: bool = False

    def with_ranks(self, ranks: DataFrame | None) -> Index:
        return replace(self, ranks=best_ranks(ranks))


def best_ranks(ranks: DataFrame | None) -> DataFrame | None:
    return None if ranks is None else ranks.groupBy("doc_id").agg(F.max("rank").alias("rank"))


def stored_table(docs: DataFrame) -> DataFrame:
    uri = docs.select("doc_id", "uri", *[c for c in ("title", "body", "anchors") if c in docs.columns])
    return uri.select("doc_id", "uri", index.length_of(uri).alias("length"))


def of(docs: DataFrame | Index, ranks: DataFrame | None = None) -> Index:
    """An index that isn't written: for a single search."""
    return docs if isinstance(docs, Index) else Index(index.postings(docs), stored_table(docs), best_ranks(ranks))


def build(docs: DataFrame, ranks: DataFrame | None = None) -> Index:
    """Write postings and documents to the shared folder; postings are written once and not shuffled."""
    return Index(write_shared(index.postings(docs), "postings"), write_shared(stored_table(docs), "stored"), best_ranks(ranks), True)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term): distinct bare terms and phrase words."""
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("terms", none), F.coalesce(F.flatten(F.coalesce("phrases", F.array().cast("array<array<string>>"))), none))
    return queries.select("qid", F.explode(F.array_distinct(words)).alias("term"))


def phrase_words(queries: DataFrame) -> DataFrame:
    """(qid, phrase, size, i, term)."""
    each = queries.select("qid", F.posexplode("phrases").alias("phrase", "words")).where(F.size("words") > 0)
    return each.select("qid", "phrase", F.size("words").alias("size"), F.posexplode("words").alias("i", "term"))


def phrase_matches(token_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that hold every phrase of the query, each within one field."""
    words = phrase_words(queries)
    hits = token_rows.join(words, "term").groupBy("qid", "phrase", "size", "doc_id", "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("found"))
    per_phrase = hits.where(F.col("found") == F.col("size")).select("qid", "phrase", "doc_id").distinct()
    wanted = words.groupBy("qid").agg(F.count_distinct("phrase").alias("wanted"))
    return per_phrase.groupBy("qid", "doc_id").agg(F.count("*").alias("got")).join(wanted, "qid").where(F.col("got") == F.col("wanted")).select("qid", "doc_id")


def _vocabulary(queries: DataFrame) -> tuple[DataFrame, int]:
    """Every term that some query names or excludes, and their number."""
    named = query_terms(queries).select("term").unionByName(queries.select(F.explode("excluded").alias("term"))).distinct()
    return named, named.count()


def _chunks(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of about ``BROADCAST_TERMS`` words, which every task may hold."""
    none = F.array().cast("array<string>")
    words = F.size(F.coalesce("terms", none)) + F.size(F.coalesce("excluded", none)) + F.size(F.coalesce(F.flatten(F.coalesce("phrases", F.array().cast("array<array<string>>"))), none)) + 1
    n = -(-(queries.agg(F.sum(words)).first()[0] or 0) // BROADCAST_TERMS)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def best(docs: DataFrame | Index, queries: DataFrame, k: int, params: Params = Params(), ranks: DataFrame | None = None, shards: int = 1, local: bool = False) -> DataFrame:
    """(qid, shard, doc_id, score): at least the best ``k`` matches of every query and shard, ties by lowest id; ``shard`` is ``doc_id % shards``.

    Matches of queries and documents are far more than postings, so only postings are shuffled: those of a
    document meet in one task, which scores all queries on blocks of documents and keeps the best ``k``.
    With ``local`` a shard scores by its own statistics instead of those of all.
    """
    params.checked()
    made = of(docs, ranks)
    parts = [_best(made, part, k, params, shards, local) for part in _chunks(queries)]
    return reduce(DataFrame.unionByName, parts)


def _best(made: Index, queries: DataFrame, k: int, params: Params, shards: int, local: bool) -> DataFrame:
    vocabulary, n_terms = _vocabulary(queries)
    if n_terms <= LITERAL_TERMS:
        own = made.postings.where(F.col("term").isin([r[0] for r in vocabulary.collect()]))
    else:
        own = made.postings.join(_side(vocabulary, n_terms), "term", "left_semi")
    shard = F.pmod("doc_id", F.lit(shards)).cast("int").alias("shard")
    own = own.select("*", shard)
    if not made.kept:  # used for frequencies and scores; without this every use would split the texts again
        own = write_shared(own, "query-postings")
    keys = ["shard"] if local else []
    sizes = made.stored.select(shard, "length").groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))  # a row per shard, or one
    freqs = own.groupBy("term", *keys).agg(F.count("*").alias("df"))
    freqs = freqs.join(F.broadcast(sizes), keys) if local else freqs.crossJoin(F.broadcast(sizes))
    wanted = matching.Wanted.of(queries.select("qid", "terms", "excluded", "phrases").collect())
    found = freqs.select("term", *keys, "average", "df", idf(F.col("n"), F.col("df")).alias("idf")).collect()
    weights = [(r["term"], *[r[c] for c in keys], wanted.ids[r["term"]], wanted.ids[r["term"]] in wanted.phrase_words, r["average"], r["idf"]) for r in found]
    kinds = ["term string", *[f"{c} int" for c in keys], "id int", "placed boolean", "average double", "idf double"]
    named = _side(made.postings.sparkSession.createDataFrame(weights, ", ".join(kinds)), len(weights))
    part = F.col("idf") * saturation(params, F.col("wtf"), length_norm(params, F.col("length"), F.col("average")))
    rows = own.join(named, ["term", *keys]).select("doc_id", "shard", F.col("id").alias("term"), part.alias("part"), F.when(F.col("placed"), F.col("fields")).alias("fields"))
    if made.ranks is not None:  # a document's authority travels as one more of its postings
        ranked = made.ranks.where("doc_id is not null and rank > 0").select("doc_id", shard, "rank")
        ranked = ranked.join(F.broadcast(sizes), keys) if local else ranked.crossJoin(F.broadcast(sizes))
        rows = rows.unionByName(ranked.select("doc_id", "shard", F.lit(matching.AUTHORITY).alias("term"), authority(params, F.col("rank"), F.col("n")).alias("part")), allowMissingColumns=True)
    # tasks by shard, since each of them returns the best of every query and shard it has
    tasks = -(-max(own.sparkSession.sparkContext.defaultParallelism, sum(r["df"] for r in found) // TASK_POSTINGS) // shards)
    task = F.col("shard") * tasks + F.pmod(F.xxhash64("doc_id"), F.lit(tasks)).cast("int")
    return rows.repartitionById(shards * tasks, task).sortWithinPartitions("shard", "doc_id").mapInArrow(matching.matcher(wanted, k, SCORE_DIGITS), matching.MATCH)


def top(scores: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, uri, score): the cut keeps low ids among ties, the order is score then uri."""
    cut = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    kept = scores.withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= k).drop("_n")
    named = kept.join(docs.select("doc_id", "uri"), "doc_id")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("uri"), F.asc("doc_id"))
    return named.withColumn("rank", F.row_number().over(order)).select("qid", "rank", "doc_id", "uri", F.round("score", 6).alias("score"))


def batch_search(docs: DataFrame | Index, queries: DataFrame, k: int = 10, params: Params = Params(), ranks: DataFrame | None = None) -> DataFrame:
    made = of(docs, ranks)
    return top(best(made, queries, k, params), made.stored, k)


def search(docs: DataFrame | Index, text: str, k: int = 10, params: Params = Params(), ranks: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, uri, score) for one query text; nothing for an empty query or ``k`` of 0 (Q6)."""
    q, spark = parse(text), (docs.stored if isinstance(docs, Index) else docs).sparkSession
    if k <= 0 or q.is_empty:
        return spark.createDataFrame([], "rank int, doc_id long, uri string, score double")
    return batch_search(docs, query_table(spark, {"q": text}), k, params, ranks).drop("qid")


def sharded_search(docs: DataFrame | Index, queries: DataFrame, shards: int, k: int = 10, params: Params = Params(), ranks: DataFrame | None = None, local: bool = False) -> DataFrame:
    """Search by shard (``doc_id % shards``) and merge (K3): with statistics of all shards, or with each shard's own (``local``).

    Every shard's best ``k`` are cut side by side in one pass, then all of them together.
    """
    made = of(docs, ranks)
    cut = Window.partitionBy("qid", "shard").orderBy(F.desc("score"), F.asc("doc_id"))
    kept = best(made, queries, k, params, shards=shards, local=local).withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= k).drop("_n", "shard")
    named = kept.join(made.stored.select("doc_id", "uri"), "doc_id").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("uri"), F.asc("doc_id"))
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "doc_id", "uri", "score")
