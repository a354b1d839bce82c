"""Leases, frontier, crawl, sampling, evaluation, snippets."""

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsearch.operators import evaluate, frontier, politeness, sampling, snippet
from tarnsearch.operators.frontier import Limits
from tarnsearch.plans.crawl import Crawl

REQUEST = "host string, t timestamp_ntz, requested_ms long, permits int, arrived_at timestamp_ntz"


def requests(n, hosts=("a.example", "B.example"), seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.choice(hosts), start + dt.timedelta(seconds=rng.randrange(40_000)), rng.choice([None, 50, 900, 30_000]), rng.choice([1, 2, 16]), start + dt.timedelta(seconds=i)) for i in range(n)]


def test_lease_schedule_equals_the_recurrence(spark):
    rows = requests(300)
    rows += rows[:20] + [(None, rows[0][1], 5, 1, rows[0][4])]
    df = spark.createDataFrame(rows, REQUEST)
    got = {(r["host"], r["arrived_at"]): (r["wait_ms"], r["free_ms"]) for r in politeness.lease_schedule(df, chunk_ms=3_600_000).collect()}
    free, expected, epoch = {}, {}, dt.datetime(1970, 1, 1)
    for host, t, ms, permits, arrived in sorted({(h.lower(), *r) for h, *r in rows if h}, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3], r[4])):
        now = (t - epoch) // dt.timedelta(milliseconds=1)
        slot = max(now, free.get(host, now))
        free[host] = slot + max(ms or 0, 1000) * permits
        expected[host, arrived] = (slot - now, free[host])
    assert got == expected and any(w for w, _ in got.values())


def test_leases_of_a_stream_wait_behind_earlier_batches(spark, tmp_path):
    from tarnsearch.streaming import leases

    rows = requests(240, seed=8)
    free, expected, epoch = {}, {}, dt.datetime(1970, 1, 1)
    for part in (rows[:80], rows[80:160], rows[160:]):
        spark.createDataFrame(part, REQUEST).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
        leases.grant(stream, f"file:{tmp_path}/out").awaitTermination()
        for host, t, ms, permits, arrived in sorted({(h.lower(), *r) for h, *r in part}, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[3], r[4])):
            now = (t - epoch) // dt.timedelta(milliseconds=1)
            slot = max(now, free.get(host, now))
            free[host] = slot + max(ms or 0, 1000) * permits
            expected[host, arrived] = (slot - now, free[host])
    got = {(r["host"], r["arrived_at"]): (r["wait_ms"], r["free_ms"]) for r in leases.granted(spark, f"file:{tmp_path}/out").collect()}
    assert got == expected
    alone = politeness.without_authority(spark.createDataFrame(rows[:3], REQUEST)).collect()
    assert {r["wait_ms"] for r in alone} == {0} and all(r["spacing_ms"] >= 0 and r["permits"] >= 1 for r in alone)


def test_frontier(spark):
    found = spark.createDataFrame([("http://a.x/1", 1, 5), ("http://a.x/1", 1, 2), ("http://a.x/2", 4, 1), ("http://b.x/1", 1, 3), ("http://a.x/0", 1, 4), (None, 1, 9)], "url string, depth int, seq long")
    seen = spark.createDataFrame([("http://a.x/0",)], "url string")
    hosts = spark.createDataFrame([("a.x",)], "host string")
    assert [tuple(r) for r in frontier.admitted(found, seen, hosts).collect()] == [("http://a.x/1", 1, 2)]
    assert {r["url"] for r in frontier.admitted(found, seen, hosts, Limits(same_host=False)).collect()} == {"http://a.x/1", "http://b.x/1"}
    queue = spark.createDataFrame([(f"http://{h}.x/{i}", 1, i * 2 + n) for n, h in enumerate("ab") for i in range(5)], "url string, depth int, seq long")
    out = frontier.handed_out(queue, spark.createDataFrame([("a.x", 2)], "host string, pages long"), 1, Limits(pages=4, per_host=3)).collect()
    assert [r["url"] for r in out] == ["http://a.x/0", "http://b.x/0", "http://b.x/1"]


def test_anchor_texts_are_distinct_and_capped(spark):
    rows = [("t", f" text {i % 40} ", i) for i in range(200)] + [("t", "  ", 1000), (None, "x", 0)]
    got = frontier.anchors_by_target(spark.createDataFrame(rows, "target string, text string, seq long")).collect()
    assert len(got) == 1 and got[0]["anchors"] == [f"text {i}" for i in range(32)]


PAGE = "url string, title string, text string, links array<struct<href:string,text:string>>, base string, noindex boolean, nofollow boolean"


def test_crawl_a_small_site_and_resume(spark, tmp_path):
    home = "https://site.example/"
    pages = spark.createDataFrame(
        [
            (home, "Home", "welcome", [("/a", "first"), ("b", "second"), ("/private/x", "secret"), ("https://other.example/", "off"), ("/a#top", "again")], None, False, False),
            (home + "a", "A", "text a", [("/b", "to b"), ("/c", "to c")], "", False, False),
            (home + "b", "B", "text b", [("/c", "hidden")], None, False, True),
            (home + "c", "C", "text c", [("/d", "x")], None, True, False),
            (home + "private/x", "P", "no", [], None, False, False),
        ],
        PAGE,
    )
    rules = spark.createDataFrame([("site.example", "/private", False)], "host string, path string, allow boolean")
    crawl = Crawl(spark, str(tmp_path / "one"), rules=rules)
    crawl.start([home, home])
    docs = {r["uri"]: r for r in crawl.run(pages).collect()}
    assert set(docs) == {home, home + "a", home + "b"}
    assert docs[home + "b"]["anchors"] == ["second", "to b"] and docs[home + "a"]["anchors"] == ["first", "again"]
    assert crawl.counters().first().asDict() == {"fetched": 0, "indexed": 3, "disallowed": 1, "skipped": 1, "errors": 0}
    # a crawl stopped after one wave goes on with what its pointer claims
    first = Crawl(spark, str(tmp_path / "two"), rules=rules)
    first.start([home])
    first.wave(pages)
    again = Crawl(spark, str(tmp_path / "two"), rules=rules)
    assert again.spooled().count() == 1
    assert {r["uri"] for r in again.run(pages).collect()} == set(docs)


def test_sample_and_generator():
    assert sampling.sample(5, 9, 1) == [0, 1, 2, 3, 4]
    picked = sampling.sample(1000, 50, 7)
    assert picked == sorted(set(picked)) and len(picked) == 50 and picked == sampling.sample(1000, 50, 7) != sampling.sample(1000, 50, 8)
    assert sampling.Rng(0).next() == 0xE220A8397B1DCDAF  # the published first value of the generator
    assert sampling.span(["a", "b"], 3, sampling.Rng(1)) is None
    assert all(0 <= sampling.Rng(s).below(7) < 7 for s in range(99))


def test_known_items_are_found(spark):
    docs = spark.createDataFrame([(i, f"u{i}", f"title {i}", " ".join(f"w{i}x{j} common" for j in range(20)), [], None) for i in range(40)], "doc_id long, uri string, title string, body string, anchors array<string>, z string")
    items = sampling.known_items(docs, wanted=10, size=6, seed=1)
    row = sampling.known_item_report(items).first()
    assert row["queries"] == 10 and row["mrr"] == 1.0 and row["beyond"] == 0
    assert sampling.known_items(docs, field="title", wanted=5, size=6).skipped == 5


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("t", r, u) for r, u in enumerate("abcde", 1)] + [("n", 1, "x")], "topic string, rank int, uri string")
    qrels = spark.createDataFrame([("t", "b", 3), ("t", "d", 1), ("t", "z", 2), ("t", "a", 0), ("n", "x", 0), ("m", "q", 1)], "topic string, uri string, grade int")
    rows = {r["topic"]: r for r in evaluate.topic_scores(run, qrels, k=3).collect()}
    assert set(rows) == {"t", "m"}
    t = rows["t"]
    assert t["precision"] == pytest.approx(1 / 3) and t["recall"] == pytest.approx(1 / 3) and t["reciprocal_rank"] == 0.5
    assert t["average_precision"] == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert t["ndcg"] == pytest.approx((7 / math.log2(3)) / (7 + 3 / math.log2(3) + 1 / 2)) and t["success"] == 1 and t["unjudged"] == 1
    assert rows["m"]["ndcg"] == 0.0 and rows["m"]["success"] == 0
    s = evaluate.summary(evaluate.topic_scores(run, qrels, k=3)).first()
    assert s["topics"] == 2 and s["failures"] == 1 and s["mrr"] == 0.25


def test_ties(spark):
    run = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 2.0), ("q", 3, 1.0), ("r", 1, 5.0)], "qid string, doc_id long, score double")
    answers = spark.createDataFrame([("q", 2.0), ("r", 5.0)], "qid string, score double")
    assert [(r["qid"], r["score"], r["members"]) for r in evaluate.tie_groups(run, ["qid"]).collect()] == [("q", 2.0, 2)]
    assert evaluate.tie_report(run, answers).first().asDict() == {"queries": 2, "tied": 1, "mean_group": 1.5, "largest": 2, "compromised": True}


TEXT = "The harbour wakes early. " * 8 + "Then the índice grows, and a crawler reads it. " + "Nothing else happens here. " * 8 + "At last the merger runs."


def test_snippets_show_the_words():
    s = snippet.best(TEXT, ["índice", "crawler"], 80)
    data = s.text.encode()
    assert [data[a:b].decode() for a, b in s.highlights] == ["índice", "crawler"] and s.text.startswith("…") and s.text.endswith("…")
    two = snippet.best(TEXT, ["crawler", "merger"], 80)
    assert {two.text.encode()[a:b].decode() for a, b in two.highlights} == {"crawler", "merger"} and two.text.count("…") >= 2
    assert two.wrap("<", ">").count("<") == 2


def test_snippets_without_match():
    assert snippet.best(TEXT, ["absent"], 20).text.startswith("The harbour wakes") and not snippet.best(TEXT, [], 20).highlights
    assert snippet.best("", ["a"], 20) == snippet.best("abc", ["a"], 0) == snippet.Snippet()
    assert snippet.best("short", ["none"], 100).text == "short"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ñ👎.\n", max_size=300), st.integers(0, 60))
def test_snippet_highlights_are_the_terms(text, width):
    s = snippet.best(text, ["ab", "ñ"], width)
    for a, b in s.highlights:
        assert s.text.encode()[a:b].decode() in ("ab", "ñ")


def test_snippet_column(spark):
    df = spark.createDataFrame([("one two three", ["two"]), (None, ["x"]), ("abc", None)], "t string, w array<string>")
    rows = [r[0] for r in df.select(snippet.snippets(F.col("t"), F.col("w"))).collect()]
    assert rows[0]["text"] == "one two three" and [tuple(h) for h in rows[0]["highlights"]] == [(4, 7)] and rows[1]["text"] == ""
