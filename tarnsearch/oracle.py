"""The SQL that the queries are held against, over the same tables."""

from __future__ import annotations

from tarnsearch.functions.text import FOLD_FROM, FOLD_TO
from tarnsearch.functions.urls import TRACKING
from tarnsearch.operators.query import parse
from tarnsearch.queries import MIXED_QUERY, OR_QUERY, ROUNDS, RULES, SIZES

_SPACES = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

FIELDS = """f AS (SELECT doc_id, 0 AS field, 3.0 AS w, title AS t FROM crawled_document UNION ALL SELECT doc_id, 1, 1.0, body FROM crawled_document
 UNION ALL SELECT doc_id, 2, 2.0, array_to_string(anchors, ' ') FROM crawled_document)"""
TOKENS = f"""{FIELDS}, l AS (SELECT doc_id, field, w, list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), lambda x: translate(lower(x), '{FOLD_FROM}', '{FOLD_TO}')) AS ts FROM f WHERE t IS NOT NULL),
 tok AS (SELECT doc_id, field, w, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM l),
 lens AS (SELECT d.doc_id, d.uri, coalesce(sum(len(ts)), 0) AS length FROM crawled_document d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, d.uri),
 tf AS (SELECT term, doc_id, count(*) AS tf, sum(w) AS wtf FROM tok GROUP BY term, doc_id),
 ranks AS (SELECT doc_id, max(rank) AS rank FROM stored_doc GROUP BY doc_id)"""


def _quoted(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]::VARCHAR[]"


def _literal_query(text: str) -> str:
    q = parse(text)
    phrases = "[" + ", ".join(_quoted(p) for p in q.phrases) + "]::VARCHAR[][]"
    return f"(SELECT 'q' AS qid, {_quoted(q.terms)} AS terms, {_quoted(q.excluded)} AS excluded, {phrases} AS phrases)"


def _bm25(queries: str, k: int = 10, k1: float = 1.2, b: float = 0.75, ranked: bool = False, shards: int = 1, local: bool = False, columns: str = "qid, rank, doc_id, uri, score") -> str:
    """Search in SQL: documents are cut per shard, then merged; ``local`` takes each shard's own statistics."""
    shard = f"doc_id % {shards}"
    key = shard if local else "0"
    score = "sum(idf * wtf * ({k1} + 1) / (wtf + {k1} * (1 - {b} + {b} * length / greatest(average, 1))))".format(k1=k1, b=b)
    factor = "CASE WHEN coalesce(r.rank, 0) > 0 THEN 1 + 0.5 * ln(1 + r.rank * n) ELSE 1 END" if ranked else "1"
    return f"""WITH {TOKENS}, q AS (SELECT * FROM {queries}),
 stats AS (SELECT {key} AS sh, count(*) AS n, avg(length) AS average FROM lens GROUP BY 1),
 df AS (SELECT {key} AS sh, term, count(*) AS df FROM tf GROUP BY 1, 2),
 qt AS (SELECT DISTINCT qid, unnest(list_concat(terms, flatten(phrases))) AS term FROM q),
 base AS (SELECT qid, tf.doc_id, any_value(n) AS n, {score} AS base
  FROM (SELECT qt.qid, qt.term, df.sh, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, n, average FROM qt JOIN df USING (term) JOIN stats USING (sh)) i
  JOIN (SELECT *, {key} AS sh FROM tf) tf ON tf.term = i.term AND tf.sh = i.sh JOIN lens ON lens.doc_id = tf.doc_id GROUP BY qid, tf.doc_id),
 p AS (SELECT qid, generate_subscripts(phrases, 1) AS ph, unnest(phrases) AS words FROM q), pw AS (SELECT qid, ph, len(words) AS size, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS i FROM p),
 ph AS (SELECT DISTINCT qid, ph, doc_id FROM (SELECT qid, ph, size, doc_id, field, pos - i AS s FROM tok JOIN pw USING (term) GROUP BY ALL HAVING count(*) = size)),
 holds AS (SELECT qid, doc_id FROM ph GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM p WHERE p.qid = ph.qid)),
 ok AS (SELECT base.qid, base.doc_id, round(base * ({factor}), 9) AS score FROM base LEFT JOIN ranks r ON r.doc_id = base.doc_id
  WHERE (base.qid NOT IN (SELECT qid FROM p) OR EXISTS (SELECT 1 FROM holds h WHERE h.qid = base.qid AND h.doc_id = base.doc_id))
  AND NOT EXISTS (SELECT 1 FROM (SELECT qid, unnest(excluded) AS term FROM q) e JOIN tf ON tf.term = e.term WHERE e.qid = base.qid AND tf.doc_id = base.doc_id)),
 cut AS (SELECT *, row_number() OVER (PARTITION BY qid, {shard} ORDER BY score DESC, doc_id) AS c FROM ok),
 out AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {'round(score, 6)' if shards > 1 else 'score'} DESC, uri, cut.doc_id) AS rank, cut.doc_id, uri, round(score, 6) AS score FROM cut JOIN lens ON lens.doc_id = cut.doc_id WHERE c <= {k})
 SELECT {columns} FROM out WHERE rank <= {k}"""


_ONE = "rank, doc_id, uri, score"
_BY_PAGE = "search_query"

_AUTH = "lower(regexp_extract({u}, '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1))"
_TRACK = "[" + ", ".join(f"'{t}'" for t in TRACKING) + "]"


def _host(u: str) -> str:
    return f"regexp_replace(regexp_replace({_AUTH.format(u=u)}, ':[0-9]*$', ''), '\\.$', '')"


def _path(p: str) -> str:
    one = r"""CASE WHEN regexp_matches(c, '[^\x21-\x7e]|["<>`{}]') THEN url_encode(c) ELSE c END"""
    return f"array_to_string(list_transform(string_split({p}, ''), lambda c: {one}), '')"


def _canonical(u: str) -> str:
    """An absolute URL without dot segments, in canonical form; the query is encoded anew."""
    scheme, auth, port = f"lower(regexp_extract({u}, '^([A-Za-z]+)://', 1))", _AUTH.format(u=u), f"regexp_extract({_AUTH.format(u=u)}, ':([0-9]+)$', 1)"
    path, query = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)", f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_filter(string_split({query}, '&'), lambda x: x <> '' AND NOT list_contains({_TRACK}, string_split(x, '=')[1]))"
    kept = f"array_to_string(list_transform({pairs}, lambda x: url_encode(url_decode(regexp_extract(x, '^([^=]*)', 1))) || '=' || url_encode(url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1)))), '&')"
    return f"""CASE WHEN {scheme} IN ('http', 'https') THEN {scheme} || '://' || {_host(u)} || CASE WHEN {port} = '' OR {scheme} || {port} IN ('http80', 'https443') THEN '' ELSE ':' || {port} END
 || CASE WHEN {path} = '' THEN '/' ELSE {_path(path)} END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"""


_URLS = f"u AS (SELECT doc_id, {_canonical('trim(uri)')} AS url, {_host('uri')} AS host FROM crawled_document)"
_LINKS = f"""lk AS (SELECT doc_id, i, {_canonical('trim(link)')} AS dst FROM (SELECT doc_id, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS i FROM crawled_document))"""
_EDGES = f"""{_URLS}, {_LINKS}, e AS (SELECT DISTINCT url AS src, dst FROM lk JOIN u USING (doc_id) WHERE url <> dst), nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e UNION SELECT url FROM u WHERE url IS NOT NULL),
 deg AS MATERIALIZED (SELECT id, count(src) AS degree FROM nodes LEFT JOIN e ON src = id GROUP BY id)"""


def _pagerank(rounds: int = ROUNDS, tables: str = _EDGES) -> str:
    """Tables up to the last round of ranks, r<rounds>."""
    steps = ["r0 AS MATERIALIZED (SELECT id, degree, 1.0 / (SELECT count(*) FROM deg) AS score FROM deg)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        base = f"(SELECT (0.15 + 0.85 * coalesce(sum(score) FILTER (degree = 0), 0)) / count(*) FROM {p})"
        steps.append(f"r{i} AS MATERIALIZED (SELECT {p}.id, degree, {base} + 0.85 * coalesce(got, 0) AS score FROM {p} LEFT JOIN (SELECT dst AS id, sum(score / degree) AS got FROM e JOIN {p} ON src = {p}.id GROUP BY dst) g ON g.id = {p}.id)")
    return f"WITH {tables}, {', '.join(steps)}"


#: The graph of hosts in place of the graph of pages.
_HOST_EDGES = f"""{_EDGES.replace(' e AS (', ' pe AS (').split(', nodes AS (')[0]}, e AS (SELECT DISTINCT {_host('src')} AS src, {_host('dst')} AS dst FROM pe WHERE {_host('src')} <> {_host('dst')}),
 nodes AS (SELECT src AS id FROM e UNION SELECT dst FROM e), deg AS MATERIALIZED (SELECT id, count(src) AS degree FROM nodes LEFT JOIN e ON src = id GROUP BY id)"""
#: Rounds after which the ranks of hosts no longer change in six digits.
SETTLED = 90
# What each robots file of queries.ROBOTS says for the crawler: (n, rules, delay, sitemaps).
_ROBOTS = """(0, '-/private +/private/open', 2.5, ''), (1, '-/x', NULL, ''), (2, '-/own', NULL, 'https://e.example/s.xml'), (3, '', NULL, 'https://e.example/a.xml https://e.example/b.xml'), (4, '', 300.0, ''), (5, '', NULL, ''), (6, '-/two', NULL, '')"""
_STATUS = "(0, 200, '-/private +/private/open'), (1, 404, ''), (2, 503, '-/'), (3, 301, '-/'), (4, 204, '-/private +/private/open')"


_AT = "coalesce(nullif(base, ''), url)"
_RESOLVED = f"""pl AS (SELECT page_id, n, trim(href) AS href, text, {_AT} AS page_at FROM (SELECT page_id, url, base, unnest(links) AS l, generate_subscripts(links, 1) - 1 AS n FROM extracted_page), LATERAL (SELECT l.href AS href, l.text AS text)),
 ab AS (SELECT page_id, n, text, CASE WHEN href = '' OR href[1] = '#' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(page_at, '^([A-Za-z]+:)', 1) || href
  WHEN href[1] = '/' THEN regexp_extract(page_at, '^([A-Za-z]+://[^/?#]*)', 1) || href WHEN href[1] = '?' THEN regexp_extract(page_at, '^([^?#]*)', 1) || href
  ELSE regexp_extract(page_at, '^([A-Za-z]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(page_at, '^[A-Za-z]+://[^/?#]*([^?#]*/)', 1), ''), '/') || href END AS link FROM pl),
 dot AS (SELECT page_id, n, text, regexp_replace(regexp_replace(link, '/\\./', '/', 'g'), '/[^/]+/\\.\\./', '/') AS link FROM ab),
 rs AS (SELECT page_id, n, text, {_canonical('link')} AS target FROM dot)"""

_ADMITTED = f"""{_URLS}, {_LINKS}, s AS (SELECT dst AS url, 1 + doc_id % 5 AS depth, struct_pack(doc_id := doc_id, i := CAST(i AS INTEGER)) AS seq FROM lk WHERE dst IS NOT NULL),
 a AS (SELECT url, CAST(min(struct_pack(depth := depth, seq := seq)).depth AS INTEGER) AS depth, min(struct_pack(depth := depth, seq := seq)).seq AS seq FROM s WHERE depth <= 3 AND {_host('url')} IN (SELECT host FROM u WHERE host <> '')
  AND url NOT IN (SELECT url FROM u WHERE url IS NOT NULL) GROUP BY url)"""


def _robots() -> str:
    def regex(p: str) -> str:
        return "^" + p.replace("*", ".*")

    cases = sorted(RULES, key=lambda r: (-len(r[0]), not r[1]))
    when = " ".join(f"WHEN regexp_matches(path, '{regex(p)}') THEN {str(a).lower()}" for p, a in cases)
    return f"WITH {_URLS} SELECT doc_id, path, CASE WHEN coalesce(host, '') = '' THEN true {when} ELSE true END AS allowed FROM (SELECT doc_id, host, regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) AS path FROM u)"


_PAGES = "pg AS (SELECT page_id, coalesce(title, '') AS title, coalesce(text, '') AS text, links, noindex, nofollow FROM extracted_page)"


def _trimmed(t: str) -> str:
    return f"trim(regexp_replace({t}, '" + _SPACES + "', ' ', 'g'), ' ')"


_RUN = """run AS (SELECT qid AS topic, CAST(doc_id AS VARCHAR) AS uri, min(rank) AS rank FROM hit WHERE scorer = 'body' GROUP BY ALL),
 qr AS (SELECT topic, uri, CASE WHEN rank <= 3 THEN 3 WHEN rank <= 10 THEN 2 WHEN rank <= 20 THEN 1 ELSE 0 END AS grade FROM (SELECT qid AS topic, CAST(doc_id AS VARCHAR) AS uri, min(rank) AS rank FROM hit WHERE scorer = 'title' GROUP BY ALL) WHERE rank <= 40),
 ideal AS (SELECT topic, count(*) AS relevant, sum((pow(2, grade) - 1) / log2(i + 1)) FILTER (i <= 10) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY grade DESC, uri) AS i FROM qr WHERE grade > 0) GROUP BY topic),
 j AS (SELECT run.topic, rank, grade, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run.topic ORDER BY rank) AS hits FROM run LEFT JOIN qr USING (topic, uri) WHERE rank <= 100),
 per AS (SELECT topic, count(*) FILTER (grade > 0 AND rank <= 10) AS found, min(rank) FILTER (grade > 0) AS first, sum(hits / rank) FILTER (grade > 0) AS ap, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (grade > 0 AND rank <= 10) AS dcg, count(*) FILTER (grade IS NULL AND rank <= 10) AS unjudged FROM j GROUP BY topic),
 sc AS (SELECT topic, coalesce(found / 10, 0) AS precision, coalesce(found / relevant, 0) AS recall, coalesce(1 / first, 0) AS reciprocal_rank, coalesce(ap / relevant, 0) AS average_precision, coalesce(dcg / ideal, 0) AS ndcg, CASE WHEN coalesce(found, 0) > 0 THEN 1 ELSE 0 END AS success, coalesce(unjudged, 0) AS unjudged FROM ideal LEFT JOIN per USING (topic))"""

_SHARD = "s AS (SELECT shard, term, arg_max(doc_freq, reported_at) AS doc_freq, arg_max(total_docs, reported_at) AS total_docs, max(reported_at) AS reported_at FROM shard_term_stats WHERE doc_freq IS NOT NULL GROUP BY shard, term)"

ORACLE = {
    "tokenize_positions": f"WITH {TOKENS} SELECT doc_id, field, CAST(pos AS INTEGER) AS pos, term FROM tok",
    "fold_text": f"SELECT doc_id, translate(lower(title), '{FOLD_FROM}', '{FOLD_TO}') AS title, translate(lower(body), '{FOLD_FROM}', '{FOLD_TO}') AS body FROM crawled_document",
    "term_stats": f"WITH {TOKENS} SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term",
    "vocabulary": f"WITH {TOKENS} SELECT DISTINCT term FROM tok",
    "doc_lengths": f"WITH {TOKENS} SELECT doc_id, CAST(length AS INTEGER) AS length FROM lens",
    "corpus_stats": f"WITH {TOKENS} SELECT count(*) AS total_docs, CAST(sum(length) AS BIGINT) AS total_length, round(avg(length), 6) AS average_length FROM lens",
    "postings_positions": f"WITH {TOKENS} SELECT term, doc_id, field, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id, field",
    "postings_weighted_tf": f"WITH {TOKENS} SELECT term, doc_id, tf, CAST(wtf AS DOUBLE) AS wtf FROM tf",
    "idf_table": f"WITH {TOKENS} SELECT term, round(ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM tf, (SELECT count(*) AS n FROM crawled_document) GROUP BY term, n",
    "bm25_or_topk": _bm25(_literal_query(OR_QUERY), columns=_ONE),
    "bm25_single_term": _bm25(_literal_query("sawmill"), 50, columns=_ONE),
    "bm25_b_sweep": " UNION ALL ".join(f"(SELECT *, {b} AS b FROM ({_bm25(_literal_query(OR_QUERY), b=b, columns=_ONE)}))" for b in ("0.0::DOUBLE", "0.3::DOUBLE", "0.75::DOUBLE", "1.0::DOUBLE")),
    "bm25_k1_zero": _bm25(_literal_query(OR_QUERY), k1=0.0, columns=_ONE),
    "bm25_exclusion": _bm25(_literal_query("ledger saddle header -sleek -damping"), columns=_ONE),
    "phrase_docs": f"WITH {TOKENS} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'the' AND b.term = 'same'",
    "phrase_plus_terms": _bm25(_literal_query(MIXED_QUERY), ranked=True, columns=_ONE),
    "bm25_with_authority": _bm25(_literal_query(OR_QUERY), ranked=True, columns=_ONE),
    "batch_search": _bm25(_BY_PAGE, ranked=True),
    "segment_search": _bm25(_BY_PAGE, ranked=True),
    "sharded_equals_global": _bm25(_BY_PAGE, ranked=True, shards=4),
    "local_stats_ranking": _bm25(_BY_PAGE, ranked=True, shards=4, local=True),
    "shard_stats_sum": f"WITH {_SHARD} SELECT term, CAST(sum(doc_freq) AS BIGINT) AS doc_freq, count(*) AS shards FROM s GROUP BY term",
    "shard_totals": f"WITH {_SHARD} SELECT shard, arg_max(total_docs, reported_at) AS total_docs, count(*) AS terms FROM s GROUP BY shard",
    "html_text": f"""WITH {_PAGES}, x AS (SELECT page_id, title, text, coalesce(array_to_string(list_transform(links, lambda l: ' ' || l.text), ' '), '') AS lt, noindex, nofollow FROM pg)
 SELECT page_id, {_trimmed("title")} AS title, {_trimmed("title || ' ' || regexp_replace(text, chr(10), ' ', 'g') || ' ' || lt")} AS text, noindex, nofollow FROM x""",
    "html_links": f"""WITH {_PAGES}, x AS (SELECT page_id, unnest(links) AS l, generate_subscripts(links, 1) - 1 AS n FROM pg)
 SELECT page_id, CAST(n AS INTEGER) AS n, trim(l.href, ' ') AS href, {_trimmed("l.text")} AS text FROM x""",
    "entity_decode": "SELECT page_id, text FROM extracted_page WHERE text IS NOT NULL",
    "url_canonical": f"WITH {_URLS} SELECT doc_id, url FROM u",
    "url_host": f"WITH {_URLS} SELECT doc_id, nullif(host, '') AS host FROM u",
    "url_resolve": f"WITH {_RESOLVED} SELECT page_id, CAST(n AS INTEGER) AS n, target FROM rs WHERE target IS NOT NULL",
    "anchor_text_by_target": f"""WITH {_RESOLVED}, t AS (SELECT target, trim(text, ' ') AS text, min(struct_pack(p := page_id, n := n)) AS seq FROM rs WHERE target IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq, text) AS r FROM t) SELECT target, string_agg(text, '|' ORDER BY seq, text) AS anchors FROM k WHERE r <= 32 GROUP BY target""",
    "link_edges": f"WITH {_EDGES} SELECT src, dst FROM e",
    "out_degree": f"WITH {_EDGES} SELECT id, degree FROM deg",
    "dangling_nodes": f"WITH {_EDGES} SELECT id FROM deg WHERE degree = 0",
    "pagerank_links": f"{_pagerank()} SELECT id, round(score, 10) AS score FROM r{ROUNDS}",
    "pagerank_hosts": f"{_pagerank(SETTLED, _HOST_EDGES)} SELECT id, round(score, 6) AS score FROM r{SETTLED}",
    "ranks_by_url": f"{_pagerank()} SELECT doc_id, coalesce(round(score, 10), 0.0) AS rank FROM u LEFT JOIN r{ROUNDS} ON id = url",
    "index_stats": f"WITH {TOKENS} SELECT (SELECT count(*) FROM lens) AS documents, (SELECT count(DISTINCT term) FROM tok) AS terms, (SELECT round(avg(length), 6) FROM lens) AS average_length",
    "robots_parse": f"WITH {_URLS} SELECT DISTINCT host, rules, CAST(delay AS DOUBLE) AS delay, sitemaps FROM u JOIN (VALUES {_ROBOTS}) v(n, rules, delay, sitemaps) ON n = length(host) % 7 WHERE host <> ''",
    "robots_status": f"WITH {_URLS} SELECT DISTINCT host, status, rules FROM u JOIN (VALUES {_STATUS}) v(n, status, rules) ON n = length(host) % 5 WHERE host <> ''",
    "skipped_topics": f"WITH {_RUN}, q AS (SELECT DISTINCT qid AS topic FROM search_query WHERE qid IS NOT NULL) SELECT count(*) AS topics, count(*) FILTER (topic NOT IN (SELECT topic FROM qr WHERE grade > 0)) AS skipped FROM q",
    "trec_roundtrip": f"WITH {_RUN} SELECT topic, uri, grade FROM qr",
    "tie_report": """WITH h AS (SELECT qid, scorer, doc_id, max(score) AS score FROM hit WHERE score IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL), b AS (SELECT *, count(*) OVER (PARTITION BY qid, score) AS members FROM h WHERE scorer = 'body'),
 t AS (SELECT qid, doc_id FROM h WHERE scorer = 'title' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) = 1)
 SELECT count(*) AS queries, count(*) FILTER (members > 1) AS tied, round(coalesce(avg(members), 0), 6) AS mean_group, coalesce(max(members), 0) AS largest, count(*) FILTER (members > 1) * 10 > count(*) AS compromised FROM b JOIN t USING (qid, doc_id)""",
    "manifest_rebuild": "SELECT CAST(3 AS INTEGER) AS segments, count(*) AS documents FROM crawled_document",
    "authority_multiplier": "SELECT DISTINCT doc_id, round(CASE WHEN rank > 0 THEN 1 + 0.5 * ln(1 + rank * (SELECT count(*) FROM crawled_document)) ELSE 1 END, 6) AS authority FROM stored_doc",
    "lease_schedule": """WITH r AS (SELECT DISTINCT lower(host) AS host, t, requested_ms, permits, arrived_at FROM fetch_request WHERE host IS NOT NULL AND t IS NOT NULL),
 c AS (SELECT *, epoch_ms(t) AS ms, greatest(coalesce(requested_ms, 0), 1000) * coalesce(permits, 1) AS cost FROM r),
 s AS (SELECT *, sum(cost) OVER w - cost AS before FROM c WINDOW w AS (PARTITION BY host ORDER BY ms, requested_ms NULLS FIRST, permits NULLS FIRST, arrived_at NULLS FIRST ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, before + max(ms - before) OVER (PARTITION BY host ORDER BY ms, requested_ms NULLS FIRST, permits NULLS FIRST, arrived_at NULLS FIRST ROWS UNBOUNDED PRECEDING) AS slot FROM s)
 SELECT host, t, requested_ms, permits, arrived_at, CAST(slot - ms AS BIGINT) AS wait_ms, CAST(slot + cost AS BIGINT) AS free_ms FROM m""",
    "robots_rule_match": _robots(),
    "robots_ttl_latest": """WITH r AS (SELECT lower(host) AS host, arrived_at AS learned_at, coalesce(requested_ms, 0) AS answer FROM fetch_request WHERE host IS NOT NULL),
 n AS (SELECT host, max(learned_at) AS learned_at FROM r GROUP BY host)
 SELECT host, learned_at, max(answer) AS answer FROM r JOIN n USING (host, learned_at) WHERE learned_at > (SELECT max(learned_at) FROM r) - INTERVAL 24 HOUR GROUP BY host, learned_at""",
    "frontier_admission": f"WITH {_ADMITTED} SELECT url, depth, seq.doc_id AS doc_id, seq.i AS i FROM a",
    "per_host_cap": f"WITH {_ADMITTED}, c AS (SELECT *, {_host('url')} AS host FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY depth, seq) AS n FROM c) SELECT url, host, depth, seq.doc_id AS doc_id, seq.i AS i FROM d WHERE n <= 3 ORDER BY depth, seq LIMIT 500",
    "ir_topics": f"WITH {_RUN} SELECT topic, round(precision, 6) AS precision, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(average_precision, 6) AS average_precision, round(ndcg, 6) AS ndcg, CAST(success AS INTEGER) AS success, unjudged FROM sc",
    "ir_summary": f"""WITH {_RUN} SELECT count(*) AS topics, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, round(avg(ndcg), 6) AS ndcg,
 round(avg(success), 6) AS success_rate, count(*) FILTER (success = 0) AS failures, CAST(sum(unjudged) AS BIGINT) AS unjudged FROM sc""",
    "tie_groups": "SELECT qid, scorer, score, count(*) AS members FROM (SELECT DISTINCT qid, scorer, doc_id, score FROM hit) WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "merge_tiers": "SELECT * FROM (VALUES " + ", ".join(f"(CAST({s} AS BIGINT), CAST({max(0, len(str(s)) - 1)} AS INTEGER))" for s in SIZES) + ") v(bytes, tier)",
    "stream_equals_batch": """WITH r AS (SELECT DISTINCT lower(host) AS host, t, requested_ms, permits, arrived_at FROM fetch_request WHERE host IS NOT NULL AND t IS NOT NULL),
 ends AS (SELECT epoch_us(min(arrived_at)) AS a, epoch_us(max(arrived_at)) AS b FROM fetch_request),
 c AS (SELECT r.*, epoch_ms(t) AS ms, greatest(coalesce(requested_ms, 0), 1000) * coalesce(permits, 1) AS cost, CASE WHEN 3 * (epoch_us(arrived_at) - a) < b - a THEN 0 WHEN 3 * (epoch_us(arrived_at) - a) < 2 * (b - a) THEN 1 ELSE 2 END AS batch FROM r, ends),
 s AS (SELECT *, sum(cost) OVER w - cost AS before FROM c WINDOW w AS (PARTITION BY host ORDER BY batch, ms, requested_ms NULLS FIRST, permits NULLS FIRST, arrived_at NULLS FIRST ROWS UNBOUNDED PRECEDING)),
 m AS (SELECT *, before + max(ms - before) OVER (PARTITION BY host ORDER BY batch, ms, requested_ms NULLS FIRST, permits NULLS FIRST, arrived_at NULLS FIRST ROWS UNBOUNDED PRECEDING) AS slot FROM s)
 SELECT host, t, requested_ms, permits, arrived_at, CAST(slot - ms AS BIGINT) AS wait_ms, CAST(slot + cost AS BIGINT) AS free_ms FROM m""",
}


def oracle_sql():
    return dict(ORACLE)
