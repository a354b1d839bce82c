"""Queries over the test tables for the search, link, crawl and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.functions import html, routing, urls
from tarnsearch.functions.entities import decode_entities
from tarnsearch.functions.text import fold, host
from tarnsearch.operators import evaluate, frontier, graph, index, politeness, query, robots, sampling, scoring, search, snippet
from tarnsearch.operators.scoring import Params
from tarnsearch.plans.crawl import Crawl
from tarnsearch.session import shared_dir, shared_path, table
from tarnsearch.sources import segments, trec

SHARDS = 8
#: Query texts for the single-query operators.
OR_QUERY = "index crawler anchor segment query"
MIXED_QUERY = 'ledger saddle "the same" -old'
#: Rounds of PageRank in the fixed-round queries.
ROUNDS = 12
# Robots rules of every site in the match query: (pattern, allow).
RULES = (("/why-", False), ("/why-the-", True), ("/*survey", False), ("/*-notes", False), ("/*field-notes", True), ("/", True), ("/*guide-*9", False))
SIZES = (0, 1, 9, 10, 99, 100, 101, 999, 1000, 5_000_000, 99_999_999, 100_000_000, 4_294_967_296)


#: Robots files and the crawler that reads them, statuses of the answers.
AGENT = "TarnBot/1.0"
ROBOTS = (
    "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2.5",
    "User-agent: tarnbot\nHost: x\nUser-agent: other\nDisallow: /x",
    "User-agent: *\nDisallow: /all\n\nUser-agent: TARN\nDisallow: /own # note\nSitemap: https://e.example/s.xml",
    "Sitemap: https://e.example/a.xml\nUser-agent: other\nDisallow: /\n!!! junk\nSitemap: https://e.example/b.xml",
    "User-agent: *\nDisallow:\nCrawl-delay: 99999",
    "",
    "User-agent: *\nDisallow: /one\nUser-agent: *\nDisallow: /two\nCrawl-delay: -1",
)
STATUSES = (200, 404, 503, 301, 204)


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "crawled_document")


def _ranks(spark, d) -> DataFrame:
    return table(spark, d, "stored_doc").select("doc_id", "rank")


_kept: dict[tuple, search.Index] = {}


def kept_index(spark, d) -> search.Index:
    """The index of crawled_document: built by the first query that needs it, searched by all later ones of the session."""
    files = tuple(sorted((r[0], str(r[1]), r[2]) for r in spark.read.format("binaryFile").load(f"{d}/crawled_document.parquet").select("path", "modificationTime", "length").collect()))
    key = (spark.sparkContext.applicationId, shared_dir(spark), files)
    if key not in _kept:
        _kept[key] = search.build(_docs(spark, d))
    return _kept[key]


def _ranked(spark, d) -> search.Index:
    return kept_index(spark, d).with_ranks(_ranks(spark, d))


def _fielded(spark, d) -> DataFrame:
    return index.with_terms(_docs(spark, d))


def tokenize_positions(spark, d):
    return index.tokens(_fielded(spark, d)).select("doc_id", F.col("field").cast("int").alias("field"), "pos", "term")


def fold_text(spark, d):
    return _docs(spark, d).select("doc_id", fold(F.col("title")).alias("title"), fold(F.col("body")).alias("body"))


def term_stats(spark, d):
    return index.term_statistics(_fielded(spark, d))


def vocabulary(spark, d):
    return index.tokens(_fielded(spark, d)).select("term").distinct()


def doc_lengths(spark, d):
    return index.lengths(_docs(spark, d))


def corpus_stats(spark, d):
    return index.corpus_statistics(index.lengths(_docs(spark, d))).withColumn("average_length", F.round("average_length", 6))


def postings_positions(spark, d):
    return index.by_field(index.postings(_docs(spark, d))).select("term", "doc_id", "field", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def postings_weighted_tf(spark, d):
    return index.postings(_docs(spark, d)).select("term", "doc_id", F.col("tf").cast("long").alias("tf"), "wtf")


def idf_table(spark, d):
    n = _docs(spark, d).count()
    return term_stats(spark, d).select("term", F.round(scoring.idf(float(n), F.col("df")), 6).alias("idf"))


def bm25_or_topk(spark, d):
    return search.search(kept_index(spark, d), OR_QUERY)


def bm25_single_term(spark, d):
    return search.search(kept_index(spark, d), "sawmill", 50)


def bm25_b_sweep(spark, d):
    parts = [search.search(kept_index(spark, d), OR_QUERY, params=Params(b=b)).withColumn("b", F.lit(b)) for b in (0.0, 0.3, 0.75, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def bm25_k1_zero(spark, d):
    return search.search(kept_index(spark, d), OR_QUERY, params=Params(k1=0.0))


def bm25_exclusion(spark, d):
    return search.search(kept_index(spark, d), "ledger saddle header -sleek -damping")


def phrase_docs(spark, d):
    """Documents with the phrase in one field."""
    found = kept_index(spark, d).postings.where(F.col("term").isin("the", "same")).select("term", "doc_id", F.inline("fields"))
    return search.phrase_matches(found.select("term", "doc_id", "field", F.explode("positions").alias("pos")), query.query_table(spark, {"q": '"the same"'})).select("doc_id")


def phrase_plus_terms(spark, d):
    return search.search(_ranked(spark, d), MIXED_QUERY)


def bm25_with_authority(spark, d):
    return search.search(_ranked(spark, d), OR_QUERY)


def batch_search(spark, d):
    """Top ten of every search_query: terms, exclusions, phrases, field weights and authority."""
    return search.batch_search(_ranked(spark, d), table(spark, d, "search_query"))


def sharded_equals_global(spark, d):
    return search.sharded_search(_ranked(spark, d), table(spark, d, "search_query"), 4)


def local_stats_ranking(spark, d):
    return search.sharded_search(_ranked(spark, d), table(spark, d, "search_query"), 4, local=True)


def segment_search(spark, d):
    """Search over stored segments: written, merged, verified and read back."""
    store = segments.Store(spark, shared_path(spark, "store"))
    store.initialise()
    docs = _docs(spark, d)
    for s in range(3):
        store.append(docs.where(F.pmod("doc_id", F.lit(3)) == s), _ranks(spark, d))
    store.compact(per_tier=2)
    store.verify()
    return segments.search_segments(store, table(spark, d, "search_query"))


def shard_stats_sum(spark, d):
    return index.global_statistics(table(spark, d, "shard_term_stats"))


def shard_totals(spark, d):
    return index.shard_totals(table(spark, d, "shard_term_stats"))


def snippet_topk(spark, d):
    """The first three results of every query with their extracts."""
    hits = batch_search(spark, d).where("rank <= 3")
    named = hits.join(_docs(spark, d).select("doc_id", "body"), "doc_id").join(search.query_terms(table(spark, d, "search_query")).groupBy("qid").agg(F.sort_array(F.collect_set("term")).alias("terms")), "qid")
    return named.select("qid", "rank", "doc_id", snippet.snippets(F.col("body"), F.col("terms")).alias("s")).select("qid", "rank", "doc_id", F.col("s.text").alias("extract"), F.size("s.highlights").alias("highlights"))


def _escaped(col):
    return F.replace(F.replace(F.replace(F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;")), F.lit('"'), F.lit("&quot;"))


def _html(spark, d) -> DataFrame:
    """page_id, url, html: the extracted pages written as HTML again; no <title> for a null title, no paragraphs for a null text."""
    pages = table(spark, d, "extracted_page")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), "\n")
    lines = F.coalesce(lines, F.lit(""))
    title = F.coalesce(F.concat(F.lit("<title>"), _escaped(F.col("title")), F.lit("</title>")), F.lit(""))
    links = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<struct<href:string,text:string>>")), lambda x: F.concat(F.lit('<li><a class=nav href="'), _escaped(x["href"]), F.lit('"><b>'), _escaped(x["text"]), F.lit("</b></a></li>"))), "")
    head = F.concat(F.lit("<!doctype html><html><head>"), title, F.lit('<style>p { color: red }</style><meta name="robots" content="'), F.when(F.col("noindex"), "NoIndex").otherwise("all"), F.when(F.col("nofollow"), ", nofollow").otherwise(""), F.lit('"></head><body><!-- <p>gone</p> --><script>if (a < b) { "<p>gone</p>" }</script>'))
    return pages.select("page_id", "url", F.concat(head, lines, F.lit("<ul>"), links, F.lit("</ul></body></html>")).alias("html"))


def html_text(spark, d):
    return _html(spark, d).withColumn("p", html.extract(F.col("html"))).select("page_id", F.col("p.title").alias("title"), F.col("p.text").alias("text"), F.col("p.noindex").alias("noindex"), F.col("p.nofollow").alias("nofollow"))


def html_links(spark, d):
    return _html(spark, d).select("page_id", F.posexplode(html.extract(F.col("html"))["links"]).alias("n", "l")).select("page_id", "n", F.col("l.href").alias("href"), F.col("l.text").alias("text"))


def entity_decode(spark, d):
    return table(spark, d, "extracted_page").where("text is not null").select("page_id", decode_entities(_escaped(F.col("text"))).alias("text"))


def url_canonical(spark, d):
    return _docs(spark, d).select("doc_id", urls.canonical(F.col("uri")).alias("url"))


def url_host(spark, d):
    return _docs(spark, d).select("doc_id", host(F.col("uri")).alias("host"))


def _page_links(spark, d) -> DataFrame:
    pages = table(spark, d, "extracted_page").select("page_id", "url", F.coalesce(F.nullif("base", F.lit("")), F.col("url")).alias("at"), F.posexplode("links").alias("n", "l"))
    return pages.select("page_id", "n", urls.resolve(F.col("at"), F.col("l.href")).alias("target"), F.col("l.text").alias("text"), F.col("l.href").alias("href"))


def url_resolve(spark, d):
    return _page_links(spark, d).where("target is not null").select("page_id", "n", "target")


def anchor_text_by_target(spark, d):
    links = _page_links(spark, d).withColumn("seq", F.struct("page_id", "n"))
    return frontier.anchors_by_target(links).select("target", F.array_join("anchors", "|").alias("anchors"))


def _edges(spark, d) -> DataFrame:
    links = _docs(spark, d).select(urls.canonical(F.col("uri")).alias("src"), F.explode("links").alias("l")).select("src", urls.canonical(F.col("l")).alias("dst"))
    return graph.edges(links)


def link_edges(spark, d):
    return _edges(spark, d)


def out_degree(spark, d):
    e = _edges(spark, d)
    return graph.out_degrees(e, graph.nodes(e, _pages(spark, d)))


def _pages(spark, d) -> DataFrame:
    return _docs(spark, d).select(urls.canonical(F.col("uri")).alias("id"))


def dangling_nodes(spark, d):
    return out_degree(spark, d).where("degree = 0").select("id")


def pagerank_links(spark, d):
    """Ranks of the link graph after a fixed number of rounds."""
    e = _edges(spark, d)
    ranks = graph.pagerank(e, graph.nodes(e, _pages(spark, d)), graph.Options(tolerance=0.0, max_iterations=ROUNDS))
    return ranks.scores.select("id", F.round("score", 10).alias("score"))


def pagerank_hosts(spark, d):
    """Ranks of the graph of hosts until they settle, best first."""
    links = _edges(spark, d).select(host(F.col("src")).alias("src"), host(F.col("dst")).alias("dst"))
    e = graph.edges(links)
    return graph.pagerank(e, graph.nodes(e), graph.Options(tolerance=1e-9)).ranked().select("id", F.round("score", 6).alias("score"))


def authority_multiplier(spark, d):
    n = _docs(spark, d).count()
    return _ranks(spark, d).distinct().select("doc_id", F.round(scoring.authority(Params(), F.col("rank"), float(n)), 6).alias("authority"))


def ranks_by_url(spark, d):
    """The rank of each document's canonical URL in the link graph after the fixed rounds."""
    docs = _docs(spark, d).select("doc_id", urls.canonical(F.col("uri")).alias("uri"))
    ranks = pagerank_links(spark, d)
    return graph.document_ranks(docs, ranks).select("doc_id", "rank")


def index_stats(spark, d):
    """Documents, terms and average length of the kept index."""
    made = kept_index(spark, d)
    terms = made.postings.select("term").distinct().count()
    return made.stored.agg(F.count("*").alias("documents"), F.lit(terms).cast("long").alias("terms"), F.round(F.avg("length"), 6).alias("average_length"))


def lease_schedule(spark, d):
    return politeness.lease_schedule(table(spark, d, "fetch_request"))


def _rules(spark, d) -> DataFrame:
    rules = spark.createDataFrame([(p, a) for p, a in RULES], "path string, allow boolean")
    hosts = _docs(spark, d).select(host(F.col("uri")).alias("host")).where("host is not null").distinct()
    return hosts.select("host", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in rules.collect()])).alias("r")).select("host", "r.*")


def robots_rule_match(spark, d):
    paths = _docs(spark, d).select("doc_id", host(F.col("uri")).alias("host"), F.regexp_extract(urls.canonical(F.col("uri")), r"^[a-z]+://[^/]*(/.*)$", 1).alias("path"))
    return robots.matched(paths, _rules(spark, d)).select("doc_id", "path", "allowed")


def _robots_texts(spark, d) -> DataFrame:
    """host, n, text: every site with one of the robots files above."""
    hosts = _docs(spark, d).select(host(F.col("uri")).alias("host")).where("host is not null").distinct()
    n = F.pmod(F.length("host"), F.lit(len(ROBOTS)))
    return hosts.select("host", n.alias("n"), F.element_at(F.array(*[F.lit(t) for t in ROBOTS]), n + 1).alias("text"))


def _shown(rules):
    return F.array_join(F.transform(rules, lambda r: F.concat(F.when(r["allow"], "+").otherwise("-"), r["path"])), " ")


def robots_parse(spark, d):
    """Rules, delay and sitemaps that each site's file has for one crawler."""
    parsed = _robots_texts(spark, d).withColumn("r", robots.parse_column(F.col("text"), AGENT))
    return parsed.select("host", _shown(F.col("r.rules")).alias("rules"), F.col("r.delay").alias("delay"), F.array_join("r.sitemaps", " ").alias("sitemaps"))


def robots_status(spark, d):
    """What the answer's status makes of a robots file."""
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.pmod(F.length("host"), F.lit(len(STATUSES))) + 1)
    told = _robots_texts(spark, d).withColumn("status", status)
    return told.select("host", "status", _shown(robots.by_status(F.col("status"), robots.parse_column(F.lit(ROBOTS[0]), AGENT))["rules"]).alias("rules"))


def robots_ttl_latest(spark, d):
    rows = table(spark, d, "fetch_request").where("host is not null").select(F.lower("host").alias("host"), F.col("arrived_at").alias("learned_at"), F.coalesce("requested_ms", F.lit(0)).alias("answer"))
    newest = rows.agg(F.max("learned_at")).first()[0]
    return robots.known_until(rows, F.lit(newest).cast("timestamp_ntz"))


def _sightings(spark, d) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.posexplode("links").alias("i", "l"))
    return docs.select(urls.canonical(F.col("l")).alias("url"), (1 + F.pmod("doc_id", F.lit(5))).cast("int").alias("depth"), F.struct("doc_id", "i").alias("seq"))


def _admitted(spark, d) -> DataFrame:
    docs = _docs(spark, d)
    seeds = docs.select(host(F.col("uri")).alias("host")).where("host is not null").distinct()
    return frontier.admitted(_sightings(spark, d), _pages(spark, d).withColumnRenamed("id", "url"), seeds)


def frontier_admission(spark, d):
    return _admitted(spark, d).select("url", "depth", "seq.*")


def per_host_cap(spark, d):
    """What a crawl of at most 500 pages, three per host, fetches next."""
    return frontier.handed_out(_admitted(spark, d), None, 0, frontier.Limits(pages=500, per_host=3)).select("url", "host", "depth", "seq.*")


def _run(spark, d, scorer: str) -> DataFrame:
    return table(spark, d, "hit").where((F.col("scorer") == scorer) & F.col("doc_id").isNotNull()).groupBy(F.col("qid").alias("topic"), F.col("doc_id").cast("string").alias("uri")).agg(F.min("rank").alias("rank"))


def _qrels(spark, d) -> DataFrame:
    """Judgements made from the title scorer: grade 3 for its first three, 2 to rank ten, 1 to rank twenty, 0 to rank forty."""
    rank = F.col("rank")
    return _run(spark, d, "title").where("rank <= 40").select("topic", "uri", F.when(rank <= 3, 3).when(rank <= 10, 2).when(rank <= 20, 1).otherwise(0).alias("grade"))


def ir_topics(spark, d):
    s = evaluate.topic_scores(_run(spark, d, "body"), _qrels(spark, d))
    return s.select("topic", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "average_precision", "ndcg")], "success", "unjudged")


def ir_summary(spark, d):
    s = evaluate.summary(evaluate.topic_scores(_run(spark, d, "body"), _qrels(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def skipped_topics(spark, d):
    """Queries, and those among them without a relevant document in the judgements."""
    return evaluate.skipped_topics(table(spark, d, "search_query"), _qrels(spark, d), "qid")


def trec_roundtrip(spark, d):
    """The judgements written as lines of text and read back."""
    path = shared_path(spark, "judgements")
    _qrels(spark, d).select(F.concat_ws(" ", "topic", F.lit("0"), "uri", F.col("grade").cast("string"))).write.text(path)
    return trec.qrels(spark, path)


def tie_report(spark, d):
    """Ties of the body scores at each query's best title result."""
    hits = table(spark, d, "hit").where("score is not null and doc_id is not null")
    best = hits.where("scorer = 'title'").groupBy("qid").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("b")).select("qid", (-F.col("b.d")).alias("doc_id"))
    run = hits.where("scorer = 'body'").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    report = evaluate.tie_report(run, run.join(best, ["qid", "doc_id"]))
    return report.withColumn("mean_group", F.round("mean_group", 6))


def tie_groups(spark, d):
    hits = table(spark, d, "hit").select("qid", "scorer", "doc_id", "score").distinct()
    return evaluate.tie_groups(hits, ["qid", "scorer"])


def known_item(spark, d):
    return sampling.known_item_report(sampling.known_items(_docs(spark, d), wanted=100, made=kept_index(spark, d)))


def jump_hash_shards(spark, d):
    return _docs(spark, d).select("doc_id", routing.shard_for(urls.canonical(F.col("uri")), SHARDS).alias("shard"))


def crawl_counters(spark, d):
    """Three waves of a crawl over the extracted pages, from one page of every site."""
    pages = table(spark, d, "extracted_page").withColumn("url", urls.canonical(F.col("url"))).where("url is not null")
    pages = pages.groupBy("url").agg(F.min_by(F.struct("title", "text", "links", "base", "noindex", "nofollow"), "page_id").alias("p")).select("url", "p.*")
    seeds = pages.groupBy(host(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    crawl = Crawl(spark, shared_path(spark, "crawl"), frontier.Limits(pages=2000, per_host=20), _rules(spark, d))
    crawl.start(seeds.select("url"))
    crawl.run(pages, waves=3)
    return crawl.counters()


def manifest_rebuild(spark, d):
    """A store whose manifest got lost, after it was made again from the segments."""
    store = segments.Store(spark, shared_path(spark, "store"))
    store.initialise()
    for s in range(3):
        store.append(_docs(spark, d).where(F.pmod("doc_id", F.lit(3)) == s))
    store.folder.delete("manifest.json")
    return spark.createDataFrame([(len(m.entries), sum(e.documents for e in m.entries)) for m in [store.rebuild()]], "segments int, documents long")


def merge_tiers(spark, d):
    return spark.createDataFrame([(s, segments.tier_of(s)) for s in SIZES], "bytes long, tier int")


def stream_equals_batch(spark, d):
    """Leases granted by a stream in three batches by time of arrival; requests that arrive late wait behind earlier batches."""
    from tarnsearch.streaming import leases

    rows = table(spark, d, "fetch_request").distinct()
    ends = rows.agg(F.min("arrived_at").alias("a"), F.max("arrived_at").alias("b")).first()
    third = (ends["b"] - ends["a"]) / 3 if ends["a"] is not None else None
    folder = shared_path(spark, "leases")
    for n in range(3):
        low, high = (ends["a"] + third * n, ends["a"] + third * (n + 1)) if third is not None else (None, None)
        part = (F.col("arrived_at") >= F.lit(low)) if n else F.lit(True)
        part = part & (F.col("arrived_at") < F.lit(high)) if n < 2 else part
        rows.where(part).write.mode("append").parquet(f"{folder}/source")
        leases.grant(spark.readStream.schema(rows.schema).parquet(f"{folder}/source"), f"{folder}/granted").awaitTermination()
    return leases.granted(spark, f"{folder}/granted").select("host", "t", "requested_ms", "permits", "arrived_at", "wait_ms", "free_ms")


def queries():
    skip = {"queries", "kept_index"}
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in skip}
