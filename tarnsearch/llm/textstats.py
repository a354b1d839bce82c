"""Statistics of one text, computed in a Python worker."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from tarnsearch.llm.lines import clean, navigation

# Words that hold sentences together, by language; wider than any table of everyday words.
FUNCTION_WORDS = {
    "en": frozenset(
        """the a an of to in on at by for with from as into over under between without until once while because although though whereas yet but and or nor so if then than when where which who that this these those
        each every another some any no not all both few more most other such only own same our your their his her its my one it he she we they you i is are was were be been being has have had do does did will would can could
        may might must should about after before again against along during since still through too very also even ever here there what how why first last ago away out up down off near now just like long hello hi thanks""".split()
    ),
    "de": frozenset(
        """der die das den dem des ein eine einen einem einer und oder aber doch denn weil dass wenn als wie im am in an auf aus bei mit nach seit von vor zu zum zur über unter ohne durch für gegen bis um ist sind war waren wird werden
        hat haben nicht kein keine auch nur noch schon sehr es er sie wir ich ihr man sich so dann später meistens""".split()
    ),
    "fr": frozenset(
        """le la les l un une des du de d et ou mais donc car que qui dont où ne pas plus est sont était a ont il elle on nous vous ils ce cette ces son sa ses leur en au aux avec sans sous sur dans par pour selon pendant depuis avant
        après entre chez tandis puis très si comme même tout toute""".split()
    ),
    "es": frozenset(
        """el la los las un una unos unas y o pero porque que quien donde no más es son era fue ha han se su sus lo le al del de en con sin por para según sobre entre desde hasta antes después tras durante aunque cuando como muy ya
        si este esta estos ese esa mientras casi siempre todo toda""".split()
    ),
}

FEATURES = (
    "word_count", "mean_word_length", "symbol_ratio", "sentence_line_share", "common_word_share", "digit_ratio", "upper_ratio", "letter_ratio", "distinct_word_share",
    "top_word_share", "sentence_ends_per_word", "words_per_line", "compression", "list_line_share", "code_line_share", "separator_share", "long_word_share", "distinct_common_words", "garbled_share", "function_word_share", "label_line_share",
)
_LIST = re.compile(r"^\s*([-–•*+]|\d{1,3}[.)])\s+\S")
_CODE = re.compile(r"[;{}]\s*$|^\s*[\[\]{}]|\w+\s*=\s*\S+$|\w\(\)|::|^\s*(if|for|let|export|return|import|def)\b.*[({=]|:\s*(true|false|null|\d+)$|=\d")
# Without one of these no alternative above fits.
_CODE_MARKS = frozenset(";{}[]=(:")
_ENDS = frozenset(".!?…:")
_LETTERS, _DIGITS, _BLANKS, _UPPER = (bytes(c for c in range(128) if f(chr(c))) for f in (str.isalpha, str.isdigit, str.isspace, str.isupper))
BLOCK = 4096


def _counts(text: str) -> tuple[int, int, int, int]:
    """Letters, digits, blanks and capitals of a text."""
    if text.isascii():
        data = text.encode()
        return tuple(len(data) - len(data.translate(None, kind)) for kind in (_LETTERS, _DIGITS, _BLANKS, _UPPER))
    return tuple(sum(map(f, text)) for f in (str.isalpha, str.isdigit, str.isspace, str.isupper))


def statistics(text: str, common: dict[str, frozenset]) -> list[float]:
    """Values of :data:`FEATURES`; a text without words gives zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in map(clean, text.split("\n")) if x]
    letters, digits, blanks, upper = _counts(text)
    solid = max(1, size - blanks)
    low = [w.strip(".,;:!?\"'()[]«»“”").lower() for w in words]
    tally = Counter(low)
    known = [sum(c for w, c in tally.items() if w in words_of) for words_of in common.values()] or [0]
    best = max(range(len(known)), key=known.__getitem__)
    distinct_common = len(tally.keys() & list(common.values())[best]) if common else 0
    if "'" in text:
        tally.update(w.split("'")[0] for w in low if "'" in w)
    function = max(sum(c for w, c in tally.items() if w in own) for own in FUNCTION_WORDS.values())
    data = text.encode("utf-8", "replace")
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    packed = sum(len(zlib.compress(b, 1)) for b in blocks) / len(data)
    m = len(lines)
    return [
        float(n), sum(map(len, words)) / n, (solid - letters - digits) / solid, sum([x.rstrip("\"'»”)]")[-1:] in _ENDS for x in lines]) / m, known[best] / n, digits / solid, upper / solid, letters / solid,
        len(tally) / n, max(tally.values()) / n, sum(map(text.count, ".!?…")) / n, n / m, packed, sum(bool(_LIST.match(x)) for x in lines) / m, sum([not _CODE_MARKS.isdisjoint(x) and bool(_CODE.search(x)) for x in lines]) / m,
        sum(map(text.count, "|;=>\t/")) / n, sum(len(w) > 20 for w in words) / n, float(distinct_common), sum(map(text.count, "�ÃÂ")) / solid, function / n, sum(navigation(x) for x in lines) / m,
    ]
