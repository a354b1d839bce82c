"""Problem 1: lines repeated across the documents of one site.

Every line is brought to a comparison form (lower case, digit runs as ``#``, runs of blanks as one
blank).  Per site and line the number of documents is compared with the number outside the site by a
log-likelihood ratio; Benjamini-Hochberg on the ratios controls the false discoveries.  A line in significant
excess is of kind ``excess``; one that recurs in the site but is as frequent everywhere (``back to
top``) shows no excess and is ``shared``.  ``kinds`` says which are found or removed: those in excess,
unless the caller asks for more.

Nulls: rows without id, uri or site are not counted and are returned unchanged.  A null body stays
null, a body made of repeated lines only becomes the empty string.  Ties don't arise (counts and a
fixed cut).  Repeated ids count once with ``unique_ids=False``.  Empty tables give empty results.
Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsearch.functions.text import host
from tarnsearch.llm.common import one_row_per_id, small_side
from tarnsearch.session import write_shared

#: Width of a log-likelihood bin and the last bin; with these the false-discovery step sees at most 20,001 rows.
BIN_WIDTH, LAST_BIN = 0.05, 20_000


def comparison_form(col: Column) -> Column:
    """Comparison form of a text, its line breaks kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[0-9]+", "#"), "[ \t\r]+", " ")


def _lines(docs: DataFrame, id_col: str, uri_col: str, text_col: str) -> DataFrame:
    """site, line: each distinct line of a document once."""
    site = docs.select(host(F.col(uri_col)).alias("site"), F.col(text_col).alias("_text")).where("site is not null and _text is not null")
    lines = F.transform(F.split(comparison_form(F.col("_text")), "\n"), lambda x: F.trim(x))
    return site.select("site", F.explode(F.array_distinct(F.filter(lines, lambda x: x != ""))).alias("line"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def llr(k: Column, n: Column, k_out: Column, n_out: Column) -> Column:
    """Dunning's ratio for ``k`` of ``n`` against ``k_out`` of ``n_out``; negative where the rate inside is lower."""
    cells = _xlogx(k) + _xlogx(n - k) + _xlogx(k_out) + _xlogx(n_out - k_out)
    margins = _xlogx(n) + _xlogx(n_out) + _xlogx(k + k_out) + _xlogx(n + n_out - k - k_out)
    g = F.greatest(F.lit(0.0), 2 * (cells - margins + _xlogx(n + n_out)))
    return F.when(k * n_out >= k_out * n, g).otherwise(-g)


def false_discovery_cut(bins: list[tuple[int, int]], tested: int, rate: float) -> float:
    """Benjamini-Hochberg on binned ratios: each member is given its bin's lower edge, so the rate holds conservatively."""
    seen, cut = 0, math.inf
    for b, n in sorted(bins, reverse=True):
        seen += n
        p = math.erfc(math.sqrt(max(0.0, b * BIN_WIDTH) / 2))
        if b >= 0 and p <= rate * seen / tested:
            cut = b * BIN_WIDTH
    return cut


def line_counts(docs: DataFrame, id_col="doc_id", uri_col="uri", text_col="body", *, min_docs=5, rate=0.01, unique_ids=False) -> DataFrame:
    """(site, line_hash, docs, outside_docs, llr, kind) of lines in at least ``min_docs`` documents of a site.

    Only hashes are shuffled; partial counts are combined before the shuffle, so a line that a third of
    all documents carry is a few rows.
    """
    docs = one_row_per_id(docs, id_col, unique_ids)
    spark = docs.sparkSession
    pairs = write_shared(
        _lines(docs, id_col, uri_col, text_col).groupBy("site", F.xxhash64("line").alias("line_hash")).agg(F.count("*").alias("docs")),
        "site-lines",
    )
    often = pairs.where(F.col("docs") >= min_docs)
    n_often = often.count()
    hashes = small_side(often.select("line_hash").distinct(), n_often)
    everywhere = pairs.join(hashes, "line_hash", "left_semi").groupBy("line_hash").agg(F.sum("docs").alias("all_docs"))
    sites = docs.select(host(F.col(uri_col)).alias("site")).where("site is not null").groupBy("site").agg(F.count("*").alias("site_docs"))
    total = sites.agg(F.sum("site_docs")).first()[0] or 0
    k, n = F.col("docs").cast("double"), F.col("site_docs").cast("double")
    k_out = F.col("all_docs").cast("double") - k
    tested = (
        often.join(small_side(everywhere, n_often), "line_hash")
        .join(sites, "site")
        .select("site", "line_hash", "docs", (F.col("all_docs") - F.col("docs")).alias("outside_docs"), llr(k, n, k_out, F.lit(float(total)) - n).alias("llr"))
    )
    tested = write_shared(tested, "site-line-tests")
    bins = tested.groupBy(F.least(F.lit(LAST_BIN), F.floor(F.col("llr") / BIN_WIDTH)).cast("int").alias("b")).count().where("b >= 0").collect()
    cut = false_discovery_cut([(r["b"], r["count"]) for r in bins], max(1, n_often), rate)
    kind = F.when(F.col("llr") >= F.lit(min(cut, 1e300)), "excess").otherwise("shared")
    return spark.createDataFrame([], tested.schema).withColumn("kind", F.lit("shared")) if n_often == 0 else tested.withColumn("kind", kind)


def _key(site: str, line_hash: Column) -> Column:
    """Site and line in one number, so that what is broadcast has a known width."""
    return F.xxhash64(F.col(site), line_hash)


def _marked(counts: DataFrame, kinds) -> DataFrame:
    return counts.where(F.col("kind").isin(list(kinds))).select(_key("site", F.col("line_hash")).alias("key"), "outside_docs", "llr", "kind")


def repeated_lines(docs: DataFrame, id_col="doc_id", uri_col="uri", text_col="body", *, kinds=("excess",), min_docs=5, rate=0.01, unique_ids=False) -> DataFrame:
    """(site, line, docs, outside_docs, llr, kind): the repeated lines in their comparison form.

    The counts are made again on the lines themselves, so equal hashes of different lines do no harm.
    """
    counts = _marked(line_counts(docs, id_col, uri_col, text_col, min_docs=min_docs, rate=rate, unique_ids=unique_ids), kinds)
    n = counts.count()
    lines = _lines(one_row_per_id(docs, id_col, unique_ids), id_col, uri_col, text_col).withColumn("key", _key("site", F.xxhash64("line")))
    if small_side(counts, n) is not counts:
        lines = lines.join(F.broadcast(counts.select("key")), "key", "left_semi")
    exact = lines.groupBy("site", "key", "line").agg(F.count("*").alias("exact_docs")).where(F.col("exact_docs") >= min_docs)
    return exact.join(small_side(counts, n), "key").select("site", "line", F.col("exact_docs").alias("docs"), "outside_docs", "llr", "kind")


def remove_repeated_lines(docs: DataFrame, id_col="doc_id", uri_col="uri", text_col="body", *, kinds=("excess",), min_docs=5, rate=0.01, unique_ids=False) -> DataFrame:
    """(id, site, body, removed): every body without the repeated lines of its site, the rest in its old order."""
    counts = _marked(line_counts(docs, id_col, uri_col, text_col, min_docs=min_docs, rate=rate, unique_ids=unique_ids), kinds)
    n = counts.count()
    docs = one_row_per_id(docs, id_col, unique_ids)
    base = docs.select(F.col(id_col).alias("_id"), host(F.col(uri_col)).alias("_site"), F.col(text_col).alias("_text"))
    raw, form = F.split("_text", "\n"), F.split(comparison_form(F.col("_text")), "\n")
    numbered = F.zip_with(raw, F.transform(form, lambda x: F.xxhash64(F.trim(x))), lambda a, b: F.struct(a.alias("text"), b.alias("hash")))
    # the first entry stands for the document itself and never matches a line
    parts = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("hash"))), F.coalesce(numbered, F.array()))
    lines = base.select("_id", "_site", F.col("_text").isNull().alias("_null"), F.posexplode(parts).alias("_pos", "_part"))
    lines = lines.select("_id", "_site", "_null", "_pos", F.col("_part.text").alias("_line"), F.col("_part.hash").alias("_hash"))
    lines = lines.withColumn("_key", F.when(F.col("_site").isNotNull() & F.col("_hash").isNotNull(), _key("_site", F.col("_hash"))))
    marks = counts.select(F.col("key").alias("_h"))
    if small_side(marks, n) is not marks:
        kept = lines.join(F.broadcast(marks), F.col("_key") == F.col("_h"), "left_anti")
    else:  # a line may be in a third of all rows: its key is spread over 64 salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k")
        salt = F.pmod(F.xxhash64("_id"), F.lit(64)).cast("int")
        many = marks.select("_h", salts)
        kept = lines.join(many, (F.col("_key") == F.col("_h")) & (salt == F.col("_k")), "left_anti")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_pos") > 0, F.struct("_pos", "_line")))), lambda x: x["_line"]), "\n")
    return kept.groupBy("_id").agg(F.first("_site").alias("site"), F.first("_null").alias("_null"), body.alias("_body"), F.count("*").alias("_kept")).select(
        F.col("_id").alias(id_col), "site", F.when(~F.col("_null"), F.col("_body")).alias(text_col), (F.col("_kept") - 1).cast("int").alias("kept_lines")
    )
