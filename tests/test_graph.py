import pytest

from tarnsearch.operators import graph
from tarnsearch.operators.graph import Options


def ranks(spark, pairs, pages=(), **options):
    e = graph.edges(spark.createDataFrame(list(pairs), "src string, dst string"))
    p = spark.createDataFrame([(x,) for x in pages], "id string")
    r = graph.pagerank(e, graph.nodes(e, p), Options(**options))
    return {x["id"]: x["score"] for x in r.scores.collect()}, r


def plain(pairs, pages, rounds, d=0.85):
    e = {(a, b) for a, b in pairs if a != b}
    n = sorted({x for p in e for x in p} | set(pages))
    out = {x: sum(a == x for a, _ in e) for x in n}
    score = dict.fromkeys(n, 1 / len(n))
    for _ in range(rounds):
        lost = sum(score[x] for x in n if not out[x])
        score = {x: (1 - d) / len(n) + d * lost / len(n) + d * sum(score[a] / out[a] for a, b in e if b == x) for x in n}
    return score


@pytest.mark.parametrize(
    ("pairs", "pages"),
    [
        ([("hub", "a"), ("a", "hub"), ("b", "hub"), ("c", "hub")], ()),
        ([("a", "b"), ("b", "c"), ("c", "a")], ()),
        ([("a", "b"), ("a", "b"), ("a", "a"), ("b", "gone")], ("alone",)),
    ],
)
def test_against_plain_rounds(spark, pairs, pages):
    got, r = ranks(spark, pairs, pages, tolerance=0.0, max_iterations=6)
    assert got == pytest.approx(plain(pairs, pages, 6), abs=1e-12)
    assert sum(got.values()) == pytest.approx(1.0) and r.iterations == 6


def test_cycle_is_even_and_converges(spark):
    got, r = ranks(spark, [("a", "b"), ("b", "a")])
    assert got["a"] == pytest.approx(got["b"]) and r.converged and r.iterations == 1


def test_empty_and_order(spark):
    got, r = ranks(spark, [])
    assert got == {} and r.converged
    _, r = ranks(spark, [("b", "x"), ("a", "x"), ("x", "a"), ("x", "b")], max_iterations=3)
    assert [row["id"] for row in r.ranked().collect()] == ["x", "a", "b"]


def test_ranks_by_url(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "no")], "doc_id long, uri string")
    r = spark.createDataFrame([("a", 0.5)], "id string, score double")
    assert {x["doc_id"]: x["rank"] for x in graph.document_ranks(docs, r).collect()} == {1: 0.5, 2: 0.0}
