"""Token, postings and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.functions.text import term_count, terms
from tarnsearch.operators.scoring import FIELDS, WEIGHTS
from tarnsearch.session import write_shared

TOKEN_SCHEMA = "doc_id long, field tinyint, pos int, term string"


def with_terms(docs: DataFrame) -> DataFrame:
    """doc_id and the terms of each field; anchor texts share one position space; ``length`` over all fields (A4)."""
    anchors = F.array_join(F.col("anchors"), " ") if "anchors" in docs.columns else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    title = terms(F.col("title")) if "title" in docs.columns else none
    out = docs.select("doc_id", F.coalesce(title, none).alias("title"), F.coalesce(terms(F.col("body")), none).alias("body"), F.coalesce(terms(anchors), none).alias("anchor"))
    return out.withColumn("length", F.size("title") + F.size("body") + F.size("anchor"))


def length_of(docs: DataFrame) -> Column:
    """Terms of a document over all fields, counted without making them (A4)."""
    parts = [F.col("title")] if "title" in docs.columns else []
    parts += [F.col("body")] + ([F.array_join(F.col("anchors"), " ")] if "anchors" in docs.columns else [])
    return sum((term_count(p) for p in parts[1:]), term_count(parts[0]))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length) (A4)."""
    return docs.select("doc_id", length_of(docs).alias("length"))


def tokens(fielded: DataFrame, *carry: str) -> DataFrame:
    """One row per token: doc_id, field, pos, term and the columns in ``carry``; no shuffle."""
    per_field = F.explode(F.array(*[F.struct(F.lit(n).cast("tinyint").alias("field"), F.col(f).alias("ts")) for f, n in FIELDS.items()])).alias("f")
    return fielded.select("doc_id", *carry, per_field).select("doc_id", *carry, F.col("f.field").alias("field"), F.posexplode("f.ts").alias("pos", "term"))


POSTING = "term string, doc_id long, length int, tf int, wtf double, fields array<struct<field:tinyint,positions:array<int>>>"
#: Tokens that are sorted together, and postings that leave a worker together; they bound its memory.
_BLOCK, _FLUSH = 1 << 20, 65_536


def _run(ids: list[int], counts: list[list[int]], tokens: list[str]):
    """Postings of a block of documents as a record batch, sorted by term and document.

    ``counts`` has the tokens of each document's fields, ``tokens`` all of them one after another.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.array(counts, np.int64).reshape(len(ids), len(FIELDS))
    flat = sizes.ravel()
    ends = np.cumsum(flat)
    cell = np.repeat(np.arange(flat.size), flat)  # document and field of every token
    pos = np.arange(len(tokens)) - (ends - flat)[cell]
    words = pa.array(tokens, pa.string()).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    doc_ids = np.array(ids, np.int64)
    places = np.argsort(doc_ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[places] = np.arange(len(ids))
    doc, field = np.divmod(cell, len(FIELDS))
    key = number[words.indices.to_numpy()] * max(1, len(ids)) + place[doc]
    by = np.argsort(key, kind="stable")  # fields and positions stay in their order
    key, field, pos = key[by], field[by], pos[by]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    entry = np.flatnonzero(np.diff(key * len(FIELDS) + field, prepend=-1))
    term, at = np.divmod(key[first], max(1, len(ids)))
    weights = np.array([WEIGHTS[f] for f in sorted(FIELDS, key=FIELDS.get)])
    offsets = lambda starts, end: pa.array(np.append(starts, end), pa.int32())
    positions = pa.ListArray.from_arrays(offsets(entry, len(pos)), pa.array(pos, pa.int32()))
    entries = pa.StructArray.from_arrays([pa.array(field[entry], pa.int8()), positions], ["field", "positions"])
    fields = pa.ListArray.from_arrays(offsets(np.searchsorted(entry, first), len(entry)), entries)
    whole = (lambda x: np.add.reduceat(x, first)) if len(first) else (lambda x: x)
    columns = [
        words.dictionary.take(pa.array(order[term])),
        pa.array(doc_ids[places][at], pa.int64()),
        pa.array(sizes.sum(axis=1)[places][at], pa.int32()),
        pa.array(np.diff(np.append(first, len(key))), pa.int32()),
        pa.array(whole(weights[field]), pa.float64()),
        fields,
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "length", "tf", "wtf", "fields"])


def _post(batches):
    from tarnsearch.functions.text import py_terms

    def made():
        run = _run(ids, counts, tokens)
        return [run.slice(n, _FLUSH) for n in range(0, max(1, run.num_rows), _FLUSH)]

    ids, counts, tokens = [], [], []
    for b in batches:
        for doc_id, *texts in zip(*(c.to_pylist() for c in b.columns)):
            terms_of = [py_terms(text) if text else [] for text in texts]
            ids.append(doc_id)
            counts.append([len(t) for t in terms_of])
            for t in terms_of:
                tokens += t
            if len(tokens) >= _BLOCK:
                yield from made()
                ids, counts, tokens = [], [], []
    yield from made()


def postings(docs: DataFrame) -> DataFrame:
    """One row per term and document, fields inside, with ascending positions (A1-A3, T5).

    A document's terms are counted where its row is, so no token crosses the network.  Rows come in runs that
    are sorted by term and document: a term filter skips most pages of the files they are written to.  The
    document's length travels with each posting: scoring needs no join to the documents.
    """
    texts = [F.col("title") if "title" in docs.columns else F.lit(None).cast("string"), F.col("body"), F.array_join("anchors", " ") if "anchors" in docs.columns else F.lit(None).cast("string")]
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), *[t.alias(f) for t, f in zip(texts, FIELDS)]).mapInArrow(_post, POSTING)


def by_field(rows: DataFrame) -> DataFrame:
    """(term, doc_id, field, tf, positions) of postings."""
    inner = rows.select("term", "doc_id", F.inline("fields"))
    return inner.select("term", "doc_id", F.col("field").cast("int").alias("field"), F.size("positions").alias("tf"), "positions")


def term_statistics(fielded: DataFrame) -> DataFrame:
    """(term, cf, df) over all fields (A5): occurrences and distinct terms of a document leave one pass and are added per term."""
    whole = F.concat("title", "body", "anchor")
    both = F.concat(F.transform(whole, lambda t: F.struct(t.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))), F.transform(F.array_distinct(whole), lambda t: F.struct(t.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))))
    return fielded.select(F.inline(both)).groupBy("term").agg(F.sum("c").alias("cf"), F.sum("d").alias("df"))


def corpus_statistics(fielded: DataFrame) -> DataFrame:
    """One row: total_docs, total_length, average_length."""
    n, total = F.count("*"), F.coalesce(F.sum("length"), F.lit(0)).cast("long")
    return fielded.agg(n.alias("total_docs"), total.alias("total_length"), F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)).alias("average_length"))


def latest_shard_statistics(reports: DataFrame) -> DataFrame:
    """The newest complete report of every (shard, term); repeated and outdated rows drop out."""
    known = reports.where("doc_freq is not null and shard is not null and term is not null")
    newest = known.groupBy("shard", "term").agg(F.max(F.struct("reported_at", "doc_freq", "total_docs")).alias("r"))
    return newest.select("shard", "term", "r.doc_freq", "r.total_docs", "r.reported_at")


def global_statistics(reports: DataFrame) -> DataFrame:
    """(term, doc_freq, shards): shard statistics added up."""
    return latest_shard_statistics(reports).groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"), F.count("*").alias("shards"))


def shard_totals(reports: DataFrame) -> DataFrame:
    """Documents of each shard by its newest report."""
    return latest_shard_statistics(reports).groupBy("shard").agg(F.max(F.struct("reported_at", "total_docs"))["total_docs"].alias("total_docs"), F.count("*").alias("terms"))


def dense_ids(docs: DataFrame, order: str = "uri", name: str = "doc_id") -> DataFrame:
    """A number from 0 in the order of ``order`` without sorting in one task: ranges are numbered apart and shifted."""
    # written once: both branches below have to see the same ranges
    parted = write_shared(docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ranges")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    shifts = F.broadcast(sizes.select("_part", "_first", before.alias("_shift")))
    return parted.join(shifts, "_part").withColumn(name, F.col("_seq") - F.col("_first") + F.col("_shift")).drop("_part", "_seq", "_first", "_shift")
