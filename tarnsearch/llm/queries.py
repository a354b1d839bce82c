"""Queries of the training-data operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tarnsearch.functions.text import FOLD_FROM, FOLD_TO
from tarnsearch.llm import frequency, mainbody, mixing, neardup, packing, quality, ranking, residue, sitelines, spam
from tarnsearch.session import table, write_shared

#: doc_id and page_id are unique in the test tables.
UNIQUE = {"unique_ids": True}


#: TESTDATA asks for every line in five documents of a site, in excess or not.
EVERY_KIND = {"kinds": ("excess", "shared")}


def p1_found(spark, d):
    return sitelines.repeated_lines(table(spark, d, "crawled_document"), **EVERY_KIND, **UNIQUE).select("site", "line").distinct()


def p1_clean(spark, d):
    return sitelines.remove_repeated_lines(table(spark, d, "crawled_document"), **EVERY_KIND, **UNIQUE)


def _pages(spark, d):
    """The texts of problem 2: pages that are cases of problem 4 or 5 are left out."""
    pages = table(spark, d, "extracted_page")
    bad = residue.residue_pages(pages, **UNIQUE).select("page_id").unionByName(spam.spam_pages(pages, **UNIQUE).select("page_id"))
    return pages.join(write_shared(bad, "left-out"), "page_id", "left_anti"), table(spark, d, "crawled_document")


def p2_found(spark, d):
    pages, docs = _pages(spark, d)
    a = mainbody.surrounding_lines(pages, "page_id").select(F.lit("extracted_page").alias("origin"), "rec_id", "line_no")
    b = mainbody.surrounding_lines(docs, "doc_id", text_col="body").select(F.lit("crawled_document").alias("origin"), "rec_id", "line_no")
    return a.unionByName(b)


def p2_main(spark, d):
    """Every text with its main lines only."""
    a = mainbody.main_texts(table(spark, d, "extracted_page"), "page_id").select(F.lit("extracted_page").alias("origin"), "rec_id", "main_text")
    b = mainbody.main_texts(table(spark, d, "crawled_document"), "doc_id", text_col="body").select(F.lit("crawled_document").alias("origin"), "rec_id", "main_text")
    return a.unionByName(b)


def p3_found(spark, d):
    return frequency.term_frequencies(table(spark, d, "crawled_document"), **UNIQUE).where("mark is not null").select("term", "mark")


def p3_frequency(spark, d):
    return frequency.frequencies_with_reports(table(spark, d, "crawled_document"), table(spark, d, "shard_term_stats"), **UNIQUE)


def p4_found(spark, d):
    return residue.residue_pages(table(spark, d, "extracted_page"), **UNIQUE).select("page_id")


def p4_clean(spark, d):
    """The records without the pages found."""
    return residue.without_residue(table(spark, d, "extracted_page"), **UNIQUE)


def p5_found(spark, d):
    return spam.spam_pages(table(spark, d, "extracted_page"), **UNIQUE).select("page_id")


#: The similarity that TESTDATA fixes for problem 6.
TRIPLES = {"width": 3, "similarity": 0.5}


def p6_found(spark, d):
    return neardup.similar_pairs(table(spark, d, "crawled_document"), **TRIPLES, **UNIQUE).select("doc_a", "doc_b").distinct()


def p6_groups(spark, d):
    """Classes at the general setting: five words, similarity 0.8."""
    return neardup.similar_groups(table(spark, d, "crawled_document"), width=5, similarity=0.8, **UNIQUE)


def p7_found(spark, d):
    projected = ranking.combined_hits(table(spark, d, "hit"), table(spark, d, "stored_doc"))
    return ranking.head(projected, "qid", "doc_id", 10).select("qid", "doc_id")


def p7_ranking(spark, d):
    return ranking.full_order(ranking.combined_hits(table(spark, d, "hit"), table(spark, d, "stored_doc")), "qid", "doc_id")


def p8_packed(spark, d):
    return packing.packed(table(spark, d, "documents"), table(spark, d, "container_spec"), **UNIQUE)


def p8_fill(spark, d):
    """How full the containers are."""
    return packing.fill_report(p8_packed(spark, d), table(spark, d, "container_spec"))


def p9_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_target"), **UNIQUE)


def p9_uses(spark, d):
    """How often each document is used."""
    return mixing.document_uses(p9_mixture(spark, d))


def p9_shares(spark, d):
    """The share each source got."""
    return mixing.share_report(p9_mixture(spark, d), table(spark, d, "source_target"))


def p10_found(spark, d):
    return p10_statistics(spark, d).where("not is_prose").select("doc_id")


def p10_statistics(spark, d):
    return quality.judged(table(spark, d, "documents"), table(spark, d, "common_word"), **UNIQUE)


def queries():
    return {n: f for n, f in globals().items() if re.fullmatch(r"p\d+_\w+", n)}


_SITE = r"regexp_replace(lower(regexp_extract(uri, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '')"
_LINES = f"""SELECT DISTINCT doc_id, site, line FROM (
  SELECT doc_id, {_SITE} AS site, unnest(string_split(regexp_replace(regexp_replace(lower(body), '[0-9]+', '#', 'g'), '[ \t\r]+', ' ', 'g'), chr(10))) AS raw
  FROM crawled_document WHERE body IS NOT NULL), LATERAL (SELECT trim(raw, ' ') AS line) WHERE line <> '' AND site <> ''"""
_TERMS = f"""SELECT doc_id, list_transform(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+'), lambda x: translate(lower(x), '{FOLD_FROM}', '{FOLD_TO}')) AS t
  FROM crawled_document WHERE body IS NOT NULL"""

ORACLE = {
    "p1_found": f"SELECT site, line FROM ({_LINES}) GROUP BY site, line HAVING count(DISTINCT doc_id) >= 5",
    "p1_clean": f"""WITH found AS (SELECT site, line FROM ({_LINES}) GROUP BY site, line HAVING count(DISTINCT doc_id) >= 5),
 parts AS (SELECT doc_id, {_SITE} AS site, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM crawled_document WHERE body IS NOT NULL),
 forms AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '#', 'g'), '[ \t\r]+', ' ', 'g'), ' ') AS line FROM parts),
 kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) AS body, count(*) AS n FROM forms WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.site = forms.site AND f.line = forms.line) GROUP BY doc_id)
 SELECT c.doc_id, {_SITE.replace('uri', 'c.uri')} AS site, CASE WHEN c.body IS NOT NULL THEN coalesce(k.body, '') END AS body, CAST(coalesce(k.n, 0) AS INTEGER) AS kept_lines FROM crawled_document c LEFT JOIN kept k USING (doc_id)""",
    "p3_found": f"""WITH w AS (SELECT doc_id, unnest(t) AS term FROM ({_TERMS})), n AS (SELECT count(*) AS n FROM crawled_document WHERE body IS NOT NULL),
 f AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term)
 SELECT term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM f, n WHERE df <= 2 OR df > 0.67 * n""",
    "p3_frequency": f"""WITH w AS (SELECT doc_id, unnest(t) AS term FROM ({_TERMS})), n AS (SELECT count(*) AS n FROM crawled_document WHERE body IS NOT NULL),
 f AS (SELECT term, count(*) AS total_count, count(DISTINCT doc_id) AS doc_freq FROM w GROUP BY term),
 r AS (SELECT term, CAST(sum(df) AS BIGINT) AS reported_docs FROM (SELECT shard, term, arg_max(doc_freq, reported_at) AS df FROM shard_term_stats WHERE doc_freq IS NOT NULL GROUP BY shard, term) GROUP BY term)
 SELECT f.*, CASE WHEN doc_freq <= 2 THEN 'rare' WHEN doc_freq > 0.67 * n THEN 'common' END AS mark, reported_docs, doc_freq = reported_docs AS agrees FROM f CROSS JOIN n LEFT JOIN r USING (term)""",
    "p6_found": f"""WITH t AS ({_TERMS}), s AS (SELECT DISTINCT doc_id, unnest([t[i] || ' ' || t[i+1] || ' ' || t[i+2] FOR i IN range(1, len(t) - 1)]) AS g FROM t),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
 SELECT doc_a, doc_b FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE 2 * m >= x.n + y.n - m""",
}


def oracle_sql():
    return dict(ORACLE)
