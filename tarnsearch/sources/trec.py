"""Judgements and topics in the usual text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) with line numbers from 1; such files are read whole, one row per file, and are small."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).select((F.col("n") + 1).alias("n"), F.trim("line").alias("line")).where("line <> '' and not line like '#%'")


def _refuse(ok, n, what: str):
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: malformed line "), n.cast("string"))).cast("boolean"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(topic, uri, grade): four fields per line, negative grades as 0, at most 255, the last judgement of a pair counts."""
    rows = _lines(spark, path).withColumn("f", F.split("line", r"\s+"))
    sound = (F.size("f") == 4) & F.col("f")[3].rlike(r"^-?\d{1,9}$")
    rows = rows.where(_refuse(sound, F.col("n"), "judgements"))
    grade = F.least(F.greatest(F.try_element_at("f", F.lit(4)).cast("int"), F.lit(0)), F.lit(255))
    return rows.select(F.col("f")[0].alias("topic"), F.col("f")[2].alias("uri"), grade.alias("grade"), "n").groupBy("topic", "uri").agg(F.max_by("grade", "n").alias("grade"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): an id and a query per line."""
    rows = _lines(spark, path).where(_refuse(F.col("line").rlike(r"^\S+\s+\S"), F.col("n"), "topics"))
    return rows.select(F.regexp_extract("line", r"^(\S+)", 1).alias("id"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1).alias("text"))


def cranfield_qrels(rows: DataFrame) -> DataFrame:
    """Judgements (query, doc, code 1 best to 4, -1 none) with grades that rise with relevance; queries are numbered by order of appearance."""
    order = rows.groupBy("query").agg(F.min("n").alias("_first"))
    numbered = order.select("query", F.expr("cast(row_number() over (order by _first) as string)").alias("topic"))  # one row per query
    grade = F.when(F.col("code").between(1, 4), 5 - F.col("code")).otherwise(0)
    return rows.join(F.broadcast(numbered), "query").select("topic", F.col("doc").cast("string").alias("uri"), grade.cast("int").alias("grade"))


def query_text(text):
    """A topic as query text: characters with a meaning in the query language go."""
    return F.translate(text, '-"', "  ")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(n, id, part): the records of a file of ``.I`` entries in their order; Latin-1, one small file."""
    whole = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r\n", "\n").alias("text"))
    parts = whole.select(F.posexplode(F.split("text", r"(?m)^\.I (?=\d+[ \t]*$)")).alias("n", "part")).where("n > 0")
    return parts.select("n", F.regexp_extract("part", r"^(\d+)", 1).cast("long").alias("id"), F.regexp_replace("part", r"^\d+[ \t]*\n?", "").alias("part"))


def _section(part, letter: str):
    return F.regexp_extract(part, rf"(?ms)^\.{letter}[ \t]*$(.*?)(?=^\.[TABW][ \t]*$|\z)", 1)


def _flat(text):
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cranfield_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, body); the title is put before a body that doesn't open with it."""
    rows = _records(spark, path).select(F.col("id").alias("doc_id"), _flat(_section(F.col("part"), "T")).alias("title"), F.trim(F.regexp_replace(_section(F.col("part"), "W"), r"^\s+|\s+$", "")).alias("text"))
    opens = (F.col("title") != "") & F.lower(_flat(F.col("text"))).startswith(F.lower("title"))
    body = F.when(opens, F.col("text")).otherwise(F.regexp_replace(F.concat_ws("\n", "title", "text"), r"^\s+|\s+$", ""))
    return rows.select("doc_id", "title", body.alias("body"))


def cranfield_topics(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): queries numbered by their order from 1, whatever number they declare; no minus or quote is left to be read as query language."""
    text = _flat(F.regexp_replace(F.col("part"), r"(?m)^\.W", " "))
    return _records(spark, path).select(F.col("n").cast("string").alias("id"), _flat(F.regexp_replace(text, r'(?<!\w)-|"', " ")).alias("text"))


def cranfield_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(n, query, doc, code) of lines with three fields, for :func:`cranfield_qrels`; another code than 1 to 4 or -1 is an error."""
    rows = _lines(spark, path).withColumn("f", F.split("line", r"\s+")).where(F.size("f") == 3)
    row = rows.select("n", *[F.col("f")[i].cast("int").alias(c) for i, c in enumerate(("query", "doc", "code"))])
    return row.where(_refuse(F.col("code").isin(1, 2, 3, 4, -1), F.col("n"), "relevance code"))
