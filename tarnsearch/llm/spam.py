"""Problem 5: keyword-stuffed pages and lists of links or tags.

The text without navigation and legal lines is compressed in blocks (a rest up to a quarter block goes with
the block before it), once as it is and once as its *shape*: function words, punctuation and line ends stay,
every other word is ``w``, an address ``u``, a number ``#``.  Prose varies in shape; lists of different tags,
addresses or titles don't, though their words never repeat.  Either size is set against the bytes of the
text, and the logarithm of the ratio against the median of prose pages of the page's language and length, in
units of the median deviation.  Extreme redundancy of one of them flags a page, and a low density of sentence
punctuation has to confirm it: the share of words that stand in sentences, each form of a sentence
(names and numbers masked) counted once and lines that are texts of the page's links not at all.

A class of few pages is drawn towards the same length in all languages, and that towards a line over all
lengths, by their counts (``weight`` pages stand for the wider class), so small tables behave like large ones.

Error messages and template residue are problem 4's and count as sentences here.  Null texts and texts
without content or with too little of it to compress at all are never marked; null links count as none.  Repeated ids count once with
``unique_ids=False``; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.common import one_row_per_id
from tarnsearch.llm.lines import SURROUNDINGS, Kinds, clean
from tarnsearch.llm.residue import filler, rule, unfilled
from tarnsearch.llm.textstats import FUNCTION_WORDS
from tarnsearch.session import write_shared

BLOCK = 2048
# Function words that tell the languages apart.
_FUNCTION_WORDS = {
    "en": frozenset("the of and to in is for with on that this each every our one another its while as by at be are was not".split()),
    "de": frozenset("der die das den dem und nach mit im bei ist nicht auf über wie aus zum ein eine vor".split()),
    "fr": frozenset("le la les du des et en au avec sans sous un une est pas que dans pour par selon après".split()),
    "es": frozenset("el la los las del y en al con sin por tras según un una es que no para antes".split()),
}
_ALL_FUNCTION_WORDS = frozenset().union(*FUNCTION_WORDS.values(), *_FUNCTION_WORDS.values())
_MARKS, _ENDS = ",.;:!?|()\"", frozenset(".!?…")
# Where no page has been seen: natural logarithm of each ratio against log2 of the bytes, and the median deviation.
PRIORS, PRIOR_SPREAD = {"ratio": (0.6, -0.12), "shape": (0.55, -0.245)}, 0.1


class Shapes(dict):
    """The shape of a line; classes of words are remembered in a bounded table."""

    most = 200_000

    def __missing__(self, t: str) -> str:
        low = t.lower()
        c = self[t] = low if low in _ALL_FUNCTION_WORDS else "#" if t.isdigit() else t if len(t) == 1 and not t.isalnum() else "u" if t.startswith("//") else "w"
        return c

    def __call__(self, line: str) -> str:
        if len(self) > self.most:
            self.clear()
        for mark in _MARKS:
            line = line.replace(mark, f" {mark} ")
        return " ".join([self[t] for t in line.split()])


class Forms(dict):
    """A word as it counts in the form of a sentence: names and numbers are alike, the mark behind them stays."""

    most = 200_000

    def __missing__(self, t: str) -> str:
        c = self[t] = ("~" + t[-1] if t[-1] in _ENDS else "~") if t[0].isupper() or any(map(str.isdigit, t)) else t
        return c

    def sentences(self, line: str) -> list[tuple[str, ...]]:
        if len(self) > self.most:
            self.clear()
        words, out, start = [self[t] for t in line.split()], [], 0
        for i, w in enumerate(words, 1):
            if w[-1] in _ENDS or i == len(words):
                out.append(tuple(words[start:i]))
                start = i
        return out


def measure(text: str, link_texts: list[str], kinds: Kinds, shapes: Shapes, forms: Forms) -> tuple[int, str, float, float, float, float]:
    """words, language, logarithm of the blocks' ratio for the text and for its shape, share of words in distinct sentences, log2 of bytes."""
    content, words, sentence_words = [], 0, 0
    linked = {clean(t).lower() for t in link_texts if t}
    seen: set[tuple] = set()
    for raw in text.split("\n"):
        line = clean(raw)
        if not line or (k := kinds(line)) in SURROUNDINGS or k in ("byline", "date"):
            continue
        content.append(line)
        n = line.count(" ") + 1
        words += n
        if linked and line.lower() in linked:
            continue
        if k == "sentence" and n <= 45 * sum(map(line.count, ".!?…")):
            for form in forms.sentences(line):
                if form not in seen:
                    seen.add(form)
                    sentence_words += len(form)
        elif k == "code" or k == "list" and _functional(line.lower().split()) or filler(line) or k != "sentence" and (unfilled(line) or rule(line)):
            sentence_words += n
    formed = "\n".join(map(shapes, content))
    data, shape = "\n".join(content).encode(), formed.encode()
    packed = [sum(len(zlib.compress(b, 6)) for b in _blocks(x)) for x in (data, shape)]
    if packed[1] >= len(shape):  # too little to repeat anything
        return 0, "", 0.0, 0.0, 1.0, 0.0
    tally = Counter(formed.split())
    counts = {lang: sum(tally[w] for w in known) for lang, known in _FUNCTION_WORDS.items()}
    lang = max(counts, key=counts.get)
    ratio, shaped = (math.log(p / len(data)) for p in packed)
    return words, lang if counts[lang] >= 0.05 * words else "", ratio, shaped, sentence_words / max(1, words), math.log2(len(data))


def _blocks(data: bytes) -> list[bytes]:
    """The whole of the data in blocks; a short rest belongs to the block before it."""
    starts = range(0, max(1, len(data) - BLOCK // 4), BLOCK)
    return [data[i : i + BLOCK] for i in starts[:-1]] + [data[starts[-1] :]]


def _functional(words: list[str]) -> bool:
    return any(w in known for w in words for known in _FUNCTION_WORDS.values()) and words[0] in ("-", "–", "•", "+")


def _measures(batches):
    tools = Kinds(), Shapes(), Forms()
    for b in batches:
        rows = [(i, *measure(x, t or [], *tools)) for i, x, t in zip(*(c.to_pylist() for c in b.columns))]
        columns = list(zip(*rows)) or [()] * 7
        types = (pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "words", "lang", "ratio", "shape", "sentences", "bits"])


def spam_pages(pages: DataFrame, id_col="page_id", text_col="text", links_col="links", *, extreme=3.0, low_sentences=0.3, weight=20.0, unique_ids=False) -> DataFrame:
    """(page_id, ratio, deviation, sentences) of the pages found."""
    links = F.col(f"{links_col}.text") if links_col in pages.columns else F.lit(None).cast("array<string>")
    texts = one_row_per_id(pages, id_col, unique_ids).select(F.col(id_col).cast("long"), F.col(text_col), links.alias("_links")).where(F.col(text_col).isNotNull())
    seen = write_shared(texts.mapInArrow(_measures, "page_id long, words int, lang string, ratio double, shape double, sentences double, bits double"), "page-measures").where("words > 0").withColumn("bucket", F.round(F.col("bits") * 2).cast("int"))
    # texts of no known language are judged by their length alone and set no standard: filler repeats as spam does
    prose = seen.where((F.col("sentences") >= 0.5) & (F.col("lang") != ""))
    lines = prose.agg(F.count("*").alias("n"), *[f(c, "bits").alias(f"{c}_{n}") for c in PRIORS for f, n in ((F.regr_intercept, "a"), (F.regr_slope, "b"))]).first()
    quarters = lambda c: [F.percentile_approx(c, p, 10_000).alias(f"{c}_{n}") for n, p in (("m", 0.5), ("q", 0.25))]
    # a row per language and length: at most five by some hundred
    usual, overall = (prose.groupBy(*keys).agg(F.count("*").alias("n"), *quarters("ratio"), *quarters("shape")) for keys in (["lang", "bucket"], ["bucket"]))
    wider = F.broadcast(overall.select("bucket", *[F.col(c).alias(f"all_{c}") for c in overall.columns[1:]]))
    both = seen.join(F.broadcast(usual), ["lang", "bucket"], "left").join(wider, "bucket", "left").fillna(0)
    drawn = lambda n, own, wide: (n * own + weight * wide) / (n + weight)

    def deviation(c: str):
        known = lines[f"{c}_a"] is not None and lines[f"{c}_b"] is not None
        n = F.lit(float(lines["n"] if known else 0))
        line = drawn(n, F.lit(lines[f"{c}_a"] or 0.0) + F.lit(lines[f"{c}_b"] or 0.0) * F.col("bits"), F.lit(PRIORS[c][0]) + F.lit(PRIORS[c][1]) * F.col("bits"))
        middle = drawn(F.col("n"), F.col(f"{c}_m"), drawn(F.col("all_n"), F.col(f"all_{c}_m"), line))
        spread = drawn(F.col("n"), F.col(f"{c}_m") - F.col(f"{c}_q"), drawn(F.col("all_n"), F.col(f"all_{c}_m") - F.col(f"all_{c}_q"), F.lit(PRIOR_SPREAD)))
        return (F.col(c) - middle) / F.greatest(F.lit(0.02), spread)

    judged = both.withColumn("deviation", F.least(deviation("ratio"), deviation("shape")))
    return judged.where((F.col("deviation") <= -extreme) & (F.col("sentences") < low_sentences)).select("page_id", "ratio", "deviation", "sentences")
