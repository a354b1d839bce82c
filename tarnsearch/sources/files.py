"""Reading a folder of text and HTML files as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsearch.functions import html
from tarnsearch.operators.index import dense_ids

# Bytes that are searched for a NUL, and characters for an HTML start.
SNIFF_BYTES, SNIFF_CHARS = 8192, 15


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files below a folder or of one file; hidden files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(~F.col("path").rlike(r"/\.[^/]*(/|$)")).select("path", "content")


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.unhex(F.lit("00")))


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def is_html(path: Column, text: Column) -> Column:
    """By extension; without one by the first characters."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    start = F.lower(F.ltrim(text).substr(1, SNIFF_CHARS))
    sniffed = start.startswith("<!doctype html") | start.startswith("<html")
    return F.when(F.lower(name).rlike(r"\.html?$"), True).when(name.rlike(r".\.[^.]+$"), False).otherwise(sniffed)


def stem(path: Column) -> Column:
    """File name without extension, dashes and underscores as blanks."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.translate(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), "-_", "  ")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (dense, by path), uri, title, body, anchors, links."""
    texts = scan(spark, folder).where(~is_binary(F.col("content"))).select("path", decoded(F.col("content")).alias("text"))
    page = texts.withColumn("_html", is_html(F.col("path"), F.col("text"))).withColumn("_page", F.when(F.col("_html"), html.extract(F.col("text"))))
    none = F.array().cast("array<string>")
    rows = page.select(
        F.col("path").alias("uri"),
        html.page_title(F.col("_page.title"), stem(F.col("path"))).alias("title"),
        F.when(F.col("_html"), F.col("_page.text")).otherwise(F.col("text")).alias("body"),
        none.alias("anchors"),
        F.coalesce(F.col("_page.links.href"), none).alias("links"),
    )
    return dense_ids(rows, "uri").select("doc_id", "uri", "title", "body", "anchors", "links")
