"""Queries meet the documents in blocks: what is shuffled, and that blocks of any size give the same."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnsearch import queries
from tarnsearch.operators import matching, search
from tarnsearch.operators.query import query_table
from tarnsearch.sources import segments

DOCS = "doc_id long, uri string, title string, body string, anchors array<string>"


def shuffled(spark, run) -> int:
    """Rows that all shuffles of ``run`` wrote."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def corpus(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("http://s.example/"), "id").alias("uri"), F.lit("common").alias("title"), F.concat(F.lit("same word "), F.repeat(F.lit("filler "), (F.col("id") % 9).cast("int"))).alias("body"), F.lit(None).cast("array<string>").alias("anchors"))


def test_matches_are_not_shuffled(spark):
    docs, queries = corpus(spark, 600), query_table(spark, {f"q{n}": f"common same w{n}" for n in range(200)})
    got = []
    rows = shuffled(spark, lambda: got.extend(search.batch_search(search.build(docs), queries, 2).collect()))
    assert len(got) == 400 and rows < 600 * 200 / 4


def test_postings_are_made_without_a_shuffle(spark):
    docs = corpus(spark, 300)
    made = []
    assert shuffled(spark, lambda: made.append(search.build(docs))) == 0
    terms = [[r[0] for r in p] for p in made[0].postings.select("term", "doc_id").rdd.glom().collect() if p]
    assert all(t == sorted(t) for t in terms) and sum(map(len, terms)) == made[0].postings.count()


QUERIES = [
    {"qid": "a", "terms": ["x", "x", None, "y"], "excluded": None, "phrases": None},
    {"qid": "b", "terms": ["x"], "excluded": ["z"], "phrases": []},
    {"qid": "c", "terms": ["y"], "excluded": [], "phrases": [["x", "y"], []]},
    {"qid": "d", "terms": ["x"], "excluded": [], "phrases": [[]]},
    {"qid": "e", "terms": ["x"], "excluded": [], "phrases": [["x", None]]},
    {"qid": "f", "terms": [], "excluded": ["x"], "phrases": []},
    {"qid": "g", "terms": [], "excluded": [], "phrases": [["y", "y"], ["x"]]},
]
# postings of each document: score, and positions in the title and the body
POSTED = {
    2: {"x": (1.0, [0], []), "y": (0.5, [], [0])},  # x and y adjoin in no field
    4: {"x": (1.0, [], [3]), "y": (0.5, [], [4, 5])},
    6: {"x": (1.0, [], [0]), "z": (1.0, [], [1])},
    8: {"y": (2.0, [1], [])},
    10: {"x": (1.0, [], [3]), "y": (0.5, [], [4])},
}


@pytest.mark.parametrize("rows", [1, 3, 1 << 19])
@pytest.mark.parametrize("k", [0, 1, 2, 10])
def test_blocks_of_any_size_give_the_same(monkeypatch, rows, k):
    monkeypatch.setattr(matching, "_ROWS", rows)
    wanted = matching.Wanted.of(QUERIES)
    flat = []
    for doc, terms in POSTED.items():
        flat += [(doc, 0, wanted.ids[t], part, [{"field": f, "positions": at} for f, at in ((0, title), (1, body)) if at] if wanted.ids[t] in wanted.phrase_words else None) for t, (part, title, body) in terms.items()]
    flat.append((10, 0, matching.AUTHORITY, 1.25, None))
    kind = pa.list_(pa.struct([("field", pa.int8()), ("positions", pa.list_(pa.int32()))]))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), kind]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c]], t) for c, t in enumerate(kinds)], names=["doc_id", "shard", "term", "part", "fields"]) for r in flat]
    got = [r for b in matching.matcher(wanted, k, 9)(iter(batches)) for r in b.to_pylist()]
    want = {"a": [8, 10, 2, 4, 6], "b": [10, 2, 4], "c": [10, 4], "g": [4]}
    assert {q: [r["doc_id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: (-r["score"], r["doc_id"]))] for q in {r["qid"] for r in got}} == ({q: d[:k] for q, d in want.items()} if k else {})


def test_shards_meet_the_queries_in_tasks_of_their_own(spark):
    made, queries = search.build(corpus(spark, 600)), query_table(spark, {f"q{n}": f"common same w{n}" for n in range(200)})
    got = []
    rows = shuffled(spark, lambda: got.extend(search.sharded_search(made, queries, 4, 2).select("qid", "score").collect()))
    assert rows < 600 * 200 / 4
    assert sorted(got) == sorted(search.batch_search(made, queries, 2).select("qid", "score").collect())
    parts = search.best(made, queries, 2, shards=4)
    assert parts.count() == 200 * 4 * 2  # nothing is left to cut where a shard is one task


def test_a_shard_by_its_own_statistics_answers_like_an_index_of_its_own(spark):
    docs, queries = corpus(spark, 600), query_table(spark, {f"q{n}": f"common filler w{n}" for n in range(200)})
    ranks = spark.range(0, 600, 7).select(F.col("id").alias("doc_id"), (F.col("id") / 6000).alias("rank"))
    made, got = search.build(docs, ranks), []
    rows = shuffled(spark, lambda: got.extend(search.sharded_search(made, queries, 3, 2, local=True).select("qid", "score").collect()))
    assert rows < 600 * 200 / 4
    alone = [search.batch_search(docs.where(F.col("doc_id") % 3 == s), queries, 2, ranks=ranks.where(F.col("doc_id") % 3 == s)) for s in range(3)]
    best = sorted((r["qid"], -r["score"]) for a in alone for r in a.collect())
    assert sorted((r["qid"], -r["score"]) for r in got) == [r for n, r in enumerate(best) if n % 6 < 2]


def tables(spark, tmp_path, n=600, topics=200):
    corpus(spark, n).write.parquet(f"{tmp_path}/crawled_document.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0.0).alias("rank")).write.parquet(f"{tmp_path}/stored_doc.parquet")
    query_table(spark, {f"q{i}": f"common same w{i}" for i in range(topics)}).write.parquet(f"{tmp_path}/search_query.parquet")
    return str(tmp_path)


def test_extracts_shuffle_results_and_documents_only(spark, tmp_path):
    d, got = tables(spark, tmp_path), []
    rows = shuffled(spark, lambda: got.extend(queries.snippet_topk(spark, d).collect()))
    assert len(got) == 200 * 3 and all(r["highlights"] == 1 and "same" in r["extract"] for r in got) and rows < 600 * 200 / 4


def test_segments_are_written_merged_and_searched_without_a_shuffle_of_postings_or_matches(spark, tmp_path):
    d, got = tables(spark, tmp_path / "in"), []
    rows = shuffled(spark, lambda: got.extend(queries.segment_search(spark, d).collect()))
    # the postings of the queries' terms and each task's best of every query
    assert len(got) == 200 * 10 and rows < 600 * 200 / 4
    docs, store = corpus(spark, 600), segments.Store(spark, f"file:{tmp_path}/store")
    store.initialise()
    assert shuffled(spark, lambda: [store.append(docs.where(F.col("doc_id") % 2 == s)) for s in range(2)] + [store.compact(per_tier=2), store.verify()]) < 100
    assert [e.documents for e in store.manifest().entries] == [600]
