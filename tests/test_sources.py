"""Files, judgements, segments, streaming, and the driver contract."""

import pytest
from pyspark.sql import functions as F

from tarnsearch.operators import search
from tarnsearch.operators.query import query_table
from tarnsearch.operators.scoring import Params
from tarnsearch.sources import files, segments, trec
from tarnsearch.sources.segments import Manifest, Store, next_merge, tier_of

DOC = "doc_id long, uri string, title string, body string, anchors array<string>"


def docs_of(spark, ids):
    return spark.createDataFrame([(i, f"http://s.example/{i}", f"title {i % 3}", "old words " * (i % 5) + f"word{i % 7} shared", ["link text"] if i % 4 == 0 else []) for i in ids], DOC)


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "a-first_note.txt").write_text("plain <b>text</b>")
    (tmp_path / "page.HTM").write_text("<title>Page</title><p>Hello <a href=/x>x</a></p>")
    (tmp_path / "sub" / "sniffed").write_text("  <!DOCTYPE html><p>in</p>")
    (tmp_path / "latin.txt").write_bytes("año".encode("latin-1"))
    (tmp_path / "binary.bin").write_bytes(b"a\0b")
    rows = {r["uri"].rsplit("/", 1)[1]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a-first_note.txt", "page.HTM", "sniffed", "latin.txt"}
    assert rows["a-first_note.txt"]["title"] == "a first note" and rows["a-first_note.txt"]["body"] == "plain <b>text</b>"
    assert rows["page.HTM"]["title"] == "Page" and rows["page.HTM"]["links"] == ["/x"] and rows["sniffed"]["body"] == "in"
    assert rows["latin.txt"]["body"] == "año" and sorted(r["doc_id"] for r in rows.values()) == [0, 1, 2, 3]


def test_judgements_and_topics(spark, tmp_path):
    q, t, bad = tmp_path / "q", tmp_path / "t", tmp_path / "bad"
    q.write_text("# c\n1 0 a 2\n\n1 0 a 1\r\n1 0 b -3\n2 0 c 999\n")
    t.write_text("1  what is this\n#x\n2 next one\n")
    bad.write_text("1 0 a 2\n1 0 a\n")
    assert {(r["topic"], r["uri"]): r["grade"] for r in trec.qrels(spark, str(q)).collect()} == {("1", "a"): 1, ("1", "b"): 0, ("2", "c"): 255}
    assert [(r["id"], r["text"]) for r in trec.topics(spark, str(t)).orderBy("id").collect()] == [("1", "what is this"), ("2", "next one")]
    with pytest.raises(Exception, match="malformed line 2"):
        trec.qrels(spark, str(bad)).collect()
    cran = spark.createDataFrame([(1, 10, 5, 1), (2, 10, 6, 4), (3, 20, 5, -1)], "n long, query int, doc int, code int")
    assert {(r["topic"], r["uri"]): r["grade"] for r in trec.cranfield_qrels(cran).collect()} == {("1", "5"): 4, ("1", "6"): 1, ("2", "5"): 0}


def test_collection_files(spark, tmp_path):
    docs, queries, relations = tmp_path / "docs", tmp_path / "queries", tmp_path / "relations"
    docs.write_bytes(".I 1\n.T\nthe old\nmill .\n.A\nberg,a.\n.B\nj. 1\n.W\nthe old mill .\nit stands\nby the a\xf1o .\n.I 2\n.T\nempty one\n.A\n.B\n.W\n.I 3\n.T\nother\n.W\nbody only\n".encode("latin-1"))
    queries.write_text(".I 001\n.W\nwhat -is the\n\"well-known\" mill\n.I 004\n.W\nsecond .\n")
    relations.write_text("1 1 2\n1 3 -1\nnot one line here\n2 2 1\n")
    assert [tuple(r) for r in trec.cranfield_documents(spark, str(docs)).orderBy("doc_id").collect()] == [(1, "the old mill .", "the old mill .\nit stands\nby the año ."), (2, "empty one", "empty one"), (3, "other", "other\nbody only")]
    assert [tuple(r) for r in trec.cranfield_topics(spark, str(queries)).orderBy("id").collect()] == [("1", "what is the well-known mill"), ("2", "second .")]
    rows = trec.cranfield_judgements(spark, str(relations))
    assert {(r["topic"], r["uri"]): r["grade"] for r in trec.cranfield_qrels(rows).collect()} == {("1", "1"): 3, ("1", "3"): 0, ("2", "2"): 4}
    relations.write_text("1 1 7\n")
    with pytest.raises(Exception, match="relevance code"):
        trec.cranfield_judgements(spark, str(relations)).collect()


def test_merge_policy():
    assert [tier_of(s) for s in (0, 9, 10, 99, 100, 10**9)] == [0, 0, 1, 1, 2, 9] and tier_of(10**30) <= 63 and tier_of(8, 1) == 3
    assert next_merge([5] * 7) == [] and next_merge([5] * 9) == list(range(8))
    assert next_merge([50, 5, 5, 50], per_tier=2) == [1, 2]
    assert next_merge([6, 6, 6], per_tier=3, max_merged=13) == [0, 1] and next_merge([6, 9], per_tier=2, max_merged=13) == []
    sizes, merges = [], 0
    for _ in range(5000):  # equal flushes stay logarithmic in number
        sizes.append(1000)
        while places := next_merge(sizes, max_merged=1 << 60):
            total = sum(sizes[i] for i in places)
            sizes = [total if i == places[0] else s for i, s in enumerate(sizes) if i == places[0] or i not in places]
            merges += 1
    assert len(sizes) < 45 and sum(sizes) == 5_000_000 and merges < 900


def test_one_and_many_segments_answer_alike(spark, tmp_path):
    queries = query_table(spark, {"a": "word3 shared", "b": '"old words" -word2', "c": "absent"})
    whole, parts = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "parts"))
    whole.initialise()
    whole.append(docs_of(spark, range(40)))
    parts.initialise()
    for s in range(3):
        parts.append(docs_of(spark, range(s, 40, 3)))
    answer = lambda store: sorted(map(tuple, segments.search_segments(store, queries).collect()))
    direct = sorted(map(tuple, search.batch_search(docs_of(spark, range(40)), queries).collect()))
    assert answer(whole) == answer(parts) == direct and direct
    assert parts.compact(per_tier=2) >= 1 and answer(parts) == direct and parts.orphans() == []
    assert sum(e.documents for e in parts.manifest().entries) == 40
    parts.verify()
    copy = Store(spark, str(tmp_path / "copy"))
    assert copy.sync_from(parts) and copy.sync_from(parts) == [] and answer(copy) == direct
    stats = whole.statistics().first()
    assert (stats["segments"], stats["documents"]) == (1, 40)
    # a manifest that got lost is made again from the folders
    held = copy.manifest()
    copy.folder.delete("manifest.json")
    again = copy.rebuild()
    assert {(e.name, e.digest, e.documents) for e in again.entries} == {(e.name, e.digest, e.documents) for e in held.entries} and answer(copy) == direct
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "nothing")).rebuild()


def test_searchers_look_again_when_told(spark, tmp_path):
    queries = query_table(spark, {"a": "word3 shared"})
    source, replica = Store(spark, f"file:{tmp_path}/source"), Store(spark, f"file:{tmp_path}/replica")
    for store in (source, replica):
        store.initialise()
    source.append(docs_of(spark, range(10)))
    served, broken = segments.Served(replica, source), segments.Served(replica, Store(spark, f"file:{tmp_path}/none"))
    assert served.search(queries).count() == 0
    answers = segments.notify([served, broken])
    assert answers[0] == {"fetched": 1, "segments": 1, "documents": 10} and "FileNotFoundError" in answers[1]
    assert served.search(queries).count() == 10 and served.refresh()["fetched"] == 0
    assert segments.tier_histogram([5, 7, 50, 5000]) == {0: 2, 1: 1, 3: 1}


def test_torn_and_altered_indexes_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.initialise(Params(k1=1.0))
    store.append(docs_of(spark, range(5)))
    first = store.manifest()
    text = first.encode()
    with pytest.raises(ValueError, match="incomplete"):
        Manifest.decode(text.replace('"count": 1', '"count": 2'))
    with pytest.raises(ValueError, match="another version"):
        Manifest.decode(text.replace('"version": 2', '"version": 9'))
    name = store.manifest().entries[0].name
    spark.createDataFrame([(99, "u", 1, 0.0)], "doc_id long, uri string, length int, rank double").write.mode("append").parquet(store.path(name, "docs"))
    with pytest.raises(ValueError, match="changed"):
        store.verify()
    store.folder.delete(name)
    with pytest.raises(FileNotFoundError):
        store.read("docs")


def test_streamed_segments_equal_a_batch(spark, tmp_path):
    from tarnsearch.streaming.ingest import ingest

    for n in range(4):
        docs_of(spark, range(n * 10, n * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    store.initialise()
    ingest(spark, str(tmp_path / "in"), DOC, store, str(tmp_path / "cp"), per_tier=2).awaitTermination()
    queries = query_table(spark, {"a": "word3 shared"})
    assert sorted(map(tuple, segments.search_segments(store, queries).collect())) == sorted(map(tuple, search.batch_search(docs_of(spark, range(40)), queries).collect()))


def test_late_records_leave_the_windows(spark, tmp_path):
    from tarnsearch.functions.text import terms
    from tarnsearch.streaming.ingest import term_counts

    rows = [("2024-01-01 01:00:00", "a b a"), ("2024-01-05 01:00:00", "a"), ("2024-03-01 00:00:00", "z")]
    late = [("2024-01-01 02:00:00", "late"), ("2024-04-20 00:00:00", "y")]
    for part in (rows, [("2024-03-20 00:00:00", "y")], late):
        spark.createDataFrame(part, "at string, body string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = term_counts(stream, "at", terms(F.col("body"))).writeStream.outputMode("append").format("memory").queryName("late_terms").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["term"], r["n"]) for r in spark.table("late_terms").collect()}
    assert ("a", 2) in got and ("a", 1) in got and not any(t == "late" for t, _ in got)


def test_entry_contract(spark, data):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert e.entry(spark).count() > 0
