"""Term extraction: one definition for Spark expressions and one for Python workers.

A term is a maximal run of alphabetic or numeric characters of the original text,
lower-cased and then stripped of accents.  Both forms below give the same terms.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented lower-case letters and the letter each becomes.
FOLDS = (
    ("a", "àáâãäåāăą"),
    ("e", "èéêëēĕėęě"),
    ("i", "ìíîïĩīĭįı"),
    ("o", "òóôõöøōŏő"),
    ("u", "ùúûüũūŭůűų"),
    ("y", "ýÿŷ"),
    ("n", "ñńņň"),
    ("c", "çćĉċč"),
    ("g", "ĝğġģ"),
    ("h", "ĥħ"),
    ("j", "ĵ"),
    ("k", "ķĸ"),
    ("l", "ĺļľŀł"),
    ("r", "ŕŗř"),
    ("s", "śŝşšſ"),
    ("t", "ţťŧ"),
    ("w", "ŵ"),
    ("z", "źżž"),
    ("d", "ðďđ"),
    ("p", "þ"),
)

FOLD_FROM = "".join(letters for _, letters in FOLDS)
FOLD_TO = "".join(base * len(letters) for base, letters in FOLDS)
TERM_PATTERN = r"[\p{IsAlphabetic}\p{N}]+"

_FOLD_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def fold(col: Column) -> Column:
    """Lower-case and strip accents (T1, T2); capital sigma always becomes the medial form."""
    return F.translate(F.lower(F.translate(col, "Σ", "σ")), FOLD_FROM, FOLD_TO)


def terms(col: Column) -> Column:
    """ARRAY<STRING> of the terms of a text in order (T3); null gives null, a text without terms an empty array.

    Terms are split off first and folded afterwards.  Only the dotted capital I becomes something that
    splits a word when folded, so texts without it are folded whole, which is much cheaper.
    """
    split_first = F.transform(F.regexp_extract_all(col, F.lit(TERM_PATTERN), F.lit(0)), fold)
    return F.when(F.contains(col, F.lit("İ")), split_first).otherwise(query_terms(col))


def term_count(col: Column) -> Column:
    """Number of terms of a text, without making them; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(TERM_PATTERN)), F.lit(0))


def query_terms(col: Column) -> Column:
    """Terms of a query word: folded first, split afterwards (the order in which queries are read)."""
    return F.regexp_extract_all(fold(col), F.lit(TERM_PATTERN), F.lit(0))


def py_terms(text: str) -> list[str]:
    """The terms of ``text`` inside a Python worker; agrees with :func:`terms`."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    out = [w.lower() for w in _WORD.findall(text.replace("Σ", "σ"))]
    return [w if w.isascii() else w.translate(_FOLD_TABLE) for w in out]


def py_query_terms(text: str) -> list[str]:
    """Python form of :func:`query_terms`."""
    return _WORD.findall(text.replace("Σ", "σ").lower().translate(_FOLD_TABLE))


def host(col: Column) -> Column:
    """Site of an absolute URL: host in lower case without user, port or trailing dot; null when there is none."""
    name = F.regexp_extract(col, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    name = F.regexp_replace(F.lower(name), r"\.$", "")
    return F.when(name != "", name)
