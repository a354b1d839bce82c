"""Search against a scorer in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from tarnsearch.functions.text import py_terms
from tarnsearch.operators import index, scoring, search
from tarnsearch.operators.query import parse, query_table
from tarnsearch.operators.scoring import Params

DOCS = "doc_id long, uri string, title string, body string, anchors array<string>, extra string"
THREE = [
    (1, "http://e.example/a", "Motor de búsqueda", "Un motor que indexa páginas en español, rápido y pequeño.", ["el buscador", "motor colombiano"], "x"),
    (2, "http://e.example/b", "History of search", "The search engine was written in perl; every page is indexed.", [], "y"),
    (3, "http://e.example/c", None, "motor motor motor search", None, None),
]


def plain_search(docs, text, k, params=Params(), ranks=None):
    q = parse(text)
    fields = {d[0]: (py_terms(d[2] or ""), py_terms(d[3] or ""), py_terms(" ".join(d[4] or []))) for d in docs}
    weights = (3.0, 1.0, 2.0)
    n = len(docs)
    length = {i: sum(map(len, f)) for i, f in fields.items()}
    average = sum(length.values()) / max(1, n)
    wtf = {t: {i: sum(w * f.count(t) for w, f in zip(weights, fs)) for i, fs in fields.items() if any(t in f for f in fs)} for t in q.scoring_terms()}

    def holds(i, phrase):
        return any(f[s : s + len(phrase)] == phrase for f in fields[i] for s in range(len(f)))

    out = []
    for i, fs in fields.items():
        if q.phrases and not all(holds(i, p) for p in q.phrases) or not any(i in wtf[t] for t in wtf) or any(e in f for e in q.excluded for f in fs):
            continue
        score = 0.0
        for t in wtf:
            if i in wtf[t]:
                idf = math.log((n - len(wtf[t]) + 0.5) / (len(wtf[t]) + 0.5) + 1)
                norm = 1 - params.b + params.b * length[i] / max(average, 1)
                score += idf * wtf[t][i] * (params.k1 + 1) / (wtf[t][i] + params.k1 * norm)
        r = (ranks or {}).get(i, 0.0)
        out.append((round(score * (1 + params.authority_weight * math.log1p(r * n) if r > 0 else 1), 9), i))
    cut = sorted(out, key=lambda x: (-x[0], x[1]))[:k]
    uri = {d[0]: d[1] for d in docs}
    return [(i, round(s, 6)) for s, i in sorted(cut, key=lambda x: (-x[0], uri[x[1]]))]


def found(df):
    return [(r["doc_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_three_documents(spark):
    docs = spark.createDataFrame(THREE, DOCS)
    for text in ("motor", "motor search", '"motor que" search', "search -perl", '"el buscador motor"', "absent", 'perl "motor de busqueda"'):
        assert found(search.search(docs, text)) == plain_search(THREE, text, 10), text
    # anchors share one position space, so a phrase may run over two of them
    assert [i for i, _ in found(search.search(docs, '"buscador motor"'))] == [1]
    assert search.search(docs, "motor", 0).count() == 0 and search.search(docs, "-motor").count() == 0


def corpus(n):
    words = ["filler", "noise", "common", "medium", "rare"]
    rows = []
    for i in range(n):
        body = ["common"] * (1 + i % 3) + (["medium"] if i % 13 == 0 else []) + (["rare"] if i % 97 == 0 else []) + (["noise"] * 2 if i % 7 == 0 else []) + ["filler"] * (i % 41)
        rows.append((i, f"http://s.example/{(i * 7919) % 10007}", words[i % 5], " ".join(body), ["common medium"] if i % 11 == 0 else [], None))
    return rows


def test_skewed_corpus_equals_plain_search(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, DOCS).cache()
    ranks = {i: (i % 10) / 1000 for i in range(400)}
    rank_df = spark.createDataFrame(list(ranks.items()), "doc_id long, rank double")
    texts = {f"q{n}": t for n, t in enumerate(["common", "rare", "medium noise", "common rare -noise", '"common medium"', '"noise noise" rare', "filler"])}
    queries = query_table(spark, texts)
    for k in (1, 3, 50):
        got = search.batch_search(docs, queries, k, ranks=rank_df).collect()
        for q, t in texts.items():
            assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == plain_search(rows, t, k, ranks=ranks), (t, k)


def test_shards_agree_with_one_index_only_under_global_statistics(spark):
    rows = [(2 * i, f"u{i:03}", "", "apple " * 3 + ("pear" if i < 2 else ""), [], None) for i in range(12)] + [(2 * i + 1, f"v{i:03}", "", "pear plum" + " apple" * (i % 2), [], None) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    queries = query_table(spark, {"q": "apple pear"})
    one = search.batch_search(docs, queries, 20).select("doc_id", "score").collect()
    assert search.sharded_search(docs, queries, 2, 20).select("doc_id", "score").collect() == one
    assert search.sharded_search(docs, queries, 2, 20, local=True).select("doc_id", "score").collect() != one


def test_equal_documents_are_cut_by_id_and_ordered_by_uri(spark):
    rows = [(i, f"http://t.example/{9 - i}", "", "same words", [], None) for i in range(6)]
    got = search.search(spark.createDataFrame(rows, DOCS), "same", 3).collect()
    assert [r["doc_id"] for r in got] == [2, 1, 0]


def test_authority_breaks_ties_but_makes_no_match(spark):
    rows = [(1, "a", "", "twin page", [], None), (2, "b", "", "twin page", [], None), (3, "c", "", "other", [], None)]
    ranks = spark.createDataFrame([(2, 0.4), (3, 0.6)], "doc_id long, rank double")
    got = search.search(spark.createDataFrame(rows, DOCS), "twin", ranks=ranks).collect()
    assert [r["doc_id"] for r in got] == [2, 1]


def test_empty_corpus_and_null_texts(spark):
    empty = spark.createDataFrame([], DOCS)
    assert search.search(empty, "word").count() == 0
    assert index.corpus_statistics(index.with_terms(empty)).first().asDict() == {"total_docs": 0, "total_length": 0, "average_length": 0.0}
    nothing = spark.createDataFrame([(1, "u", None, None, None, None)], DOCS)
    assert index.with_terms(nothing).first()["length"] == 0


def test_parameters():
    assert Params().is_usable and not Params(k1=-1).is_usable and not Params(b=math.nan).is_usable
    with pytest.raises(ValueError):
        Params(authority_weight=math.inf).checked()


def test_segments_with_other_parameters_are_refused(spark):
    rows = spark.createDataFrame([(1.2, 0.75, 0.5), (1.2, 0.5, 0.5)], "k1 double, b double, authority_weight double")
    with pytest.raises(ValueError):
        scoring.common_params(rows)
    assert scoring.common_params(rows.limit(1)) == Params()


def test_latest_shard_reports(spark):
    rows = [(0, "a", 3, 10, 1), (0, "a", 4, 11, 2), (0, "a", 4, 11, 2), (1, "a", 5, 20, 1), (1, "a", None, 21, 3)]
    df = spark.createDataFrame(rows, "shard int, term string, doc_freq long, total_docs long, at int").withColumn("reported_at", F.timestamp_seconds("at"))
    assert index.global_statistics(df).first()["doc_freq"] == 9


def test_dense_ids(spark):
    df = spark.range(1000).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("uri")).repartition(7)
    rows = index.dense_ids(df).orderBy("uri").collect()
    assert [r["doc_id"] for r in rows] == list(range(1000))
