import pytest
from pyspark.sql import functions as F

from tarnsearch.operators import robots
from tarnsearch.operators.robots import parse

AGENT = "TarnBot/1.0 (+http://t.example)"


@pytest.mark.parametrize(
    ("text", "allowed", "denied"),
    [
        ("", ["/", "/any"], []),
        ("User-agent: *\nDisallow:", ["/any"], []),
        ("User-agent: *\nDisallow: /", [], ["/", "/any"]),
        ("User-agent: *\nDisallow: /private", ["/public"], ["/private", "/private/x"]),
        ("User-agent: *\nDisallow: /a/\nAllow: /a/b/\nDisallow: /a/b/c/", ["/a/b/x"], ["/a/x", "/a/b/c/x"]),
        ("User-agent: *\nDisallow: /x\nAllow: /x", ["/x"], []),
        ("User-agent: *\nDisallow: /\n\nUser-agent: tarnbot\nDisallow: /private", ["/public"], ["/private"]),
        ("User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /private", ["/public"], ["/private"]),
        ("User-agent: alpha\nUser-agent: TARN\nDisallow: /shared", [], ["/shared"]),
        ("User-agent: *\nDisallow: /one\nUser-agent: *\nDisallow: /two", ["/one"], ["/two"]),
        ("User-agent: *\nDisallow: /*.pdf$", ["/a.pdf.html", "/a.html", "/a.pdf/b.pdf"], ["/d/a.pdf"]),
        ("User-agent: *\nDisallow: /search*\nDisallow: /*?q=", ["/other"], ["/search", "/search?q=x", "/z?q=1"]),
        ("User-agent: tarnbot\nHost: x\nUser-agent: other\nDisallow: /x", ["/y"], ["/x"]),
        ("# c\nUser-agent: * # c\n\nDisallow: /p # c\n!!! junk", ["/q"], ["/p"]),
    ],
)
def test_rules_in_python_and_as_columns(spark, text, allowed, denied):
    r = parse(text, AGENT)
    rules = spark.createDataFrame([("h", p, a) for p, a in r.rules], "host string, path string, allow boolean")
    urls = spark.createDataFrame([("h", p, p in allowed) for p in [*allowed, *denied]], "host string, path string, expected boolean")
    for row in robots.matched(urls, rules).collect():
        assert row["allowed"] == row["expected"] == r.allows(row["path"]), row["path"]


def test_delay_and_sitemaps():
    assert parse("User-agent: *\nCrawl-delay: 2.5", AGENT).delay == 2.5
    assert parse("User-agent: *\nCrawl-delay: 99999", AGENT).delay == 300.0
    for bad in ("x", "-1", "inf", "nan"):
        assert parse(f"User-agent: *\nCrawl-delay: {bad}", AGENT).delay is None
    assert parse("Sitemap: https://e.example/s.xml\nUser-agent: z\nSitemap: https://e.example/t.xml", AGENT).sitemaps == ["https://e.example/s.xml", "https://e.example/t.xml"]


def test_column_parse_and_status(spark):
    df = spark.createDataFrame([(1, 200, "User-agent: *\nDisallow: /a\nCrawl-delay: 3"), (2, 404, ""), (3, 503, None), (4, 200, None)], "i int, status int, text string")
    rows = df.withColumn("r", robots.by_status(F.col("status"), robots.parse_column(F.col("text"), AGENT))).orderBy("i").collect()
    assert [[(x["path"], x["allow"]) for x in r["r"]["rules"]] for r in rows] == [[("/a", False)], [], [("/", False)], []]
    assert rows[0]["r"]["delay"] == 3.0 and rows[1]["r"]["delay"] is None


def test_answers_expire(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 80_000, 2), ("b", 0, 3)], "host string, s long, answer int").withColumn("learned_at", F.timestamp_seconds("s")).drop("s")
    got = robots.known_until(df, F.timestamp_seconds(F.lit(90_000))).collect()
    assert [(r["host"], r["answer"]) for r in got] == [("a", 2)]
