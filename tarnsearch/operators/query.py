"""Query language: bare terms, "phrases" and -exclusions (Q1)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tarnsearch.functions.text import py_query_terms

QUERY_SCHEMA = "qid string, terms array<string>, excluded array<string>, phrases array<array<string>>"
_PIECE = re.compile(r'"(?P<phrase>[^"]*)"?|(?P<minus>-)|(?P<word>[^\s"\-][^\s"]*)')


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)

    @property
    def is_empty(self) -> bool:
        return not self.terms and not self.phrases

    def scoring_terms(self) -> list[str]:
        """Distinct bare terms and phrase words, sorted."""
        return sorted({*self.terms, *(w for p in self.phrases for w in p)})


def parse(text: str) -> Query:
    """Never fails.  A minus in front of a word excludes all of its terms; it waits over blanks and phrases for that word."""
    q, excluding = Query(), False
    for m in _PIECE.finditer(text):
        if m["minus"]:
            excluding = True
        elif m["word"]:
            (q.excluded if excluding else q.terms).extend(py_query_terms(m["word"]))
            excluding = False
        else:
            words = py_query_terms(m["phrase"])
            if len(words) > 1:
                q.phrases.append(words)
            else:
                q.terms.extend(words)
    q.terms = [t for i, t in enumerate(q.terms) if i == 0 or q.terms[i - 1] != t]
    return q


def query_table(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Parsed queries by id as a table for batch search."""
    return spark.createDataFrame([(i, q.terms, q.excluded, q.phrases) for i, q in ((i, parse(t)) for i, t in texts.items())], QUERY_SCHEMA)
