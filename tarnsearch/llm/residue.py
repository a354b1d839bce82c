"""Problem 4: template residue, filler, error messages and access notices.

Lines and titles that have the shape of a notice are masked (placeholders, addresses, dates, numbers, names
after a technical word) and hashed, and the sites that carry each hash are counted.  A form is a message when
it is *widely recurring* - carried by at least ``1 + log2(sites) / 3`` sites, so chance repeats of a larger
crawl don't count - and one of the phrase rules below fits it; neither is enough alone.  A page is excluded
when its title is such a form, when a sentence or the title holds an unfilled placeholder, or when messages
and filler stand for its content.  Sentences that mention placeholders or messages ("a template such as ...")
don't count.  Forms of every length are counted.

Rules only look at lines that a rule could fit, so nothing else is hashed; the counts are those of all pages.
A message that no other site carries isn't found: nothing tells it from a text of its own.

Pages whose title or text is null or blank are never excluded.  Repeated ids count once with
``unique_ids=False``; a page without a site counts to the site ''; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsearch.functions.text import host
from tarnsearch.llm.common import one_row_per_id, small_side
from tarnsearch.llm.lines import MONTHS, SURROUNDINGS, Kinds, clean, words_of
from tarnsearch.session import write_shared

PLACEHOLDER = re.compile(
    r"\$\{[^{}\n]{1,40}\}|\{\{[^{}\n]{0,40}\}\}|\{%[^%\n]{1,60}%\}|#\{[^{}\n]{1,40}\}|@@[\w.]{1,40}@@|\[\[[\w .]{1,40}\]\]|<%=?[^%\n]{1,40}%>|(?<![\w%])%[A-Za-z][A-Za-z_.]{2,30}%"
    r"|(?<!\w)__[A-Za-z][\w.]{1,30}?__(?!\w)|(?<!\w)\[[a-z]+(?:[_.][a-z]+)*\](?![(\w])|(?<!\w)\[[A-Z]+(?:_[A-Z]+)*\](?![(\w])|(?<![\w%])%[sd](?!\w)|\{\d\}|\[object Object\]|##\w{2,40}##|<\?(?:php|=)[^?\n]{0,80}\?>|\bMISSING_[A-Z]+\b"
)
_HOLE_HINT = re.compile(r"[${\[%@_<#]")
_MENTION = re.compile(
    r"\b(such as|templates?|placeholders?|renderer|swaps?|replaced by|stands? for|called|phrase|designers?|drafts?|the (page|crawler|reader)|syntax|variable|escaped?|vorlage|platzhalter|gabarit|plantilla|marcador|modèle)\b",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SUFFIX = re.compile(r"\s+[|\-–:]\s+[^|]{1,40}$")

# Fixed value: the usual filler passage of typesetters, without blanks.
_PASSAGE = """loremipsumdolorsitametconsecteturadipiscingelitseddoeiusmodtemporincididuntutlaboreetdoloremagnaaliquautenimadminimveniamquisnostrudexercitationullamcolaborisnisiutaliquipexeacommodoconsequat
duisauteiruredolorinreprehenderitinvoluptatevelitessecillumdoloreeufugiatnullapariaturexcepteursintoccaecatcupidatatnonproidentsuntinculpaquiofficiadeseruntmollitanimidestlaborum""".replace("\n", "")
_SYLLABLES = frozenset(_PASSAGE[i : i + 4] for i in range(len(_PASSAGE) - 3))


def _words(text: str) -> frozenset:
    return frozenset(text.split())


#: Phrase rules: a notice has a word of the first kind and one of the second (English, German, French, Spanish).
RULES = {
    "missing": (_words("page seite página listing product item document file resource content link lien url address"), _words("found gefunden introuvable encontrada encontrado exist exists existiert longer périmé removed deleted")),
    "status": (_words("error fehler erreur 400 401 403 404 410 429 500 502 503 504"), _words("not found server request unavailable gateway forbidden complete could denied timeout nicht introuvable")),
    "denied": (_words("access permission request zugriff accès acceso"), _words("denied forbidden blocked verweigert refusé denegado no")),
    "scripts": (_words("javascript script scripts cookies"), _words("enable activate activer active activar aktivieren aktiviert eingeschaltet switch turned turn need needs requires required disabled")),
    "browser": (_words("browser navigateur navegador"), _words("checking supported unsupported upgrade update outdated veraltet")),
    "human": (_words("human robot captcha mensch"), _words("prove verify tick confirm are")),
    "session": (_words("session sitzung sesión"), _words("expired timed abgelaufen expiré expirée caducado")),
    "fault": (_words("exception undefined uncaught unhandled traceback fatal database stack datenbank"), _words("line failed variable handler clients trace error code connection")),
    "apology": (_words("something oops sorry problem etwas"), _words("wrong schiefgelaufen")),
    "server": (_words("service server gateway website"), _words("unavailable temporarily down maintenance overloaded bad")),
}
# Words that make a notice when nothing else stands in the line, and words of unfilled page skeletons.
_BARE = _words(
    """error oops loading undefined null nan untitled unbenannt maintenance wartung forbidden back soon please wait we are working on it coming under construction just a one moment not found
    bald wieder da bitte warten veuillez patienter un momento próximamente try again later new page"""
)
_SKELETON = _words("lorem ipsum title heading headline text paragraph caption description item product image content section page sample example placeholder dummy tbd todo blindtext texto texte")
_FRAME = _words("insert here your goes go add replace this own words with write copy short of a service name new hier steht ein de ejemplo relleno exemple")
_NOTHING = _words("undefined null nan")
_HINTS = frozenset().union(*(a for a, _ in RULES.values()), _SKELETON, _BARE - _words("a on it we are un da not just one under back new"))

_MASK = [
    (PLACEHOLDER, "{}"),
    (re.compile(r"https?://\S+|\S+@\S+\.\w+|(?<!\w)/[\w.\-]+(?:/[\w.\-]+)+|\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+(?:\([^)\n]*\))?"), "@"),
    (re.compile(rf"\d{{1,2}}\.?\s+(?:de\s+)?(?:{MONTHS})(?:\s+(?:de\s+)?\d{{4}})?|(?:{MONTHS})\s+\d{{1,2}}(?:,?\s+\d{{4}})?|\d{{4}}-\d\d-\d\d", re.I), "§"),
    (re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{6,}\b|\d+(?:[.,:/-]\d+)*"), "#"),
    (re.compile(r"\b(variable|function|handler|class|method|module|key|table|column|file|property):? +[\"']?\w+[\"']?"), r"\1 @"),
]


def mask(line: str) -> str:
    """A cleaned line without what differs from one copy of a message to the next."""
    low = line.lower() if not _HOLE_HINT.search(line) else PLACEHOLDER.sub("{}", line).lower()
    for pattern, by in _MASK[1:]:
        low = pattern.sub(by, low)
    return low


def filler(line: str) -> bool:
    """Pseudo-Latin: most words begin with four letters that follow each other in the filler passage."""
    words = words_of(line)
    start = words[:12]
    if len(start) < 5 or sum([w[:4] in _SYLLABLES for w in start]) < 0.5 * len(start):
        return False
    return sum(w[:4] in _SYLLABLES for w in words) >= 0.6 * len(words)


def rule(line: str) -> str | None:
    """Name of the phrase rule that fits a whole line, however long; a message only where the form recurs widely."""
    tokens = words_of(line)
    known = set(tokens)
    if known.isdisjoint(_HINTS):
        if tokens and tokens[0] == "at" and mask(line).startswith("at @"):
            return "frame"
        return "repeat" if tokens and all(len(t) > 2 and len(set(t)) == 1 and t[0].isalpha() for t in known) else None
    for name, (a, b) in RULES.items():
        if not known.isdisjoint(a) and not known.isdisjoint(b):
            return name
    rest = [t for t in tokens if not t.isdigit()]
    if all(t in _BARE for t in rest):
        return "bare"
    if not known.isdisjoint(_SKELETON) and all(t in _SKELETON or t in _FRAME for t in rest):
        return "skeleton"
    return "nothing" if tokens[0] in _NOTHING else None


def unfilled(line: str) -> int:
    """Sentences of a line that hold a placeholder and don't speak of one."""
    if not _HOLE_HINT.search(line) or not PLACEHOLDER.search(line):
        return 0
    return sum(bool(PLACEHOLDER.search(s)) and not _MENTION.search(PLACEHOLDER.sub(" ", s)) for s in _SENTENCE.split(line))


def notice_title(title: str) -> str | None:
    """The title, without the site's name behind it where there is one, if a rule fits it."""
    t = clean(title)
    return next((x for x in (_SUFFIX.sub("", t), t) if rule(x)), None)


SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("site", T.StringType()), ("title_hash", T.LongType()), ("unfilled", T.IntegerType()), ("words", T.IntegerType()), ("filler_words", T.IntegerType()))]
    + [T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))]
)


def _digest(form: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(form) & 0x7FFFFFFFFFFFFFFF


def profile(page_id: int, site: str, title: str, text: str, kinds: Kinds) -> tuple:
    head = clean(title).lower()
    holes, words, said = int(bool(PLACEHOLDER.search(title))), 0, 0
    hashes, sizes = [], []
    pointed = False
    for raw in text.split("\n"):
        line = clean(raw)
        if not line:
            continue
        hole = unfilled(line)
        holes += hole
        k = kinds(line)
        if k in SURROUNDINGS:
            pointed = k == "pointer"
            continue
        own = not hole and filler(line)
        said_here = hole > 0 or own or rule(line) is not None
        if not said_here and (pointed and k == "short" or k in ("byline", "date") or line.lower() == head):
            continue
        pointed = False
        n = line.count(" ") + 1
        words += n
        if own or hole:
            said += n
        elif said_here:
            hashes.append(_digest(mask(line)))
            sizes.append(n)
    named = notice_title(title)
    return page_id, site, _digest(mask(named)) if named else None, holes, words, said, hashes, sizes


def _profiles(batches):
    kinds = Kinds()
    for b in batches:
        rows = [profile(*r, kinds) for r in zip(*(c.to_pylist() for c in b.columns))]
        columns = list(zip(*rows)) or [()] * len(SCHEMA)
        kinds_of = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=SCHEMA.names)


def wide(sites: int) -> int:
    """Sites that have to carry a form before it recurs widely; grows with the logarithm of all sites."""
    return max(2, 1 + int(math.log2(max(2, sites)) / 3))


def residue_pages(pages: DataFrame, id_col="page_id", url_col="url", title_col="title", text_col="text", *, share=0.5, min_sites: int | None = None, unique_ids=False) -> DataFrame:
    """(page_id, reason) of the pages to leave out; ``min_sites`` replaces :func:`wide`."""
    pages = one_row_per_id(pages, id_col, unique_ids)
    texts = pages.select(F.col(id_col).cast("long"), F.coalesce(host(F.col(url_col)), F.lit("")).alias("_site"), F.col(title_col).alias("_title"), F.col(text_col).alias("_text")).where((F.trim("_title") != "") & (F.trim("_text") != ""))
    seen = write_shared(texts.mapInArrow(_profiles, SCHEMA), "page-profiles")
    least = min_sites or wide(seen.agg(F.count_distinct("site")).first()[0])
    lines = F.transform(F.arrays_zip("hashes", "sizes"), lambda x: F.struct(x["hashes"].alias("h"), x["sizes"].alias("n"), F.lit(False).alias("is_title")))
    title = F.when(F.col("title_hash").isNotNull(), F.array(F.struct(F.col("title_hash").alias("h"), F.lit(0).alias("n"), F.lit(True).alias("is_title")))).otherwise(F.slice(lines, 1, 0))
    entries = seen.select("page_id", "site", "words", "filler_words", F.inline(F.concat(title, lines)))
    spread = write_shared(entries.select("h", "is_title", "site").distinct().groupBy("h", "is_title").agg(F.count("*").alias("sites")).where(F.col("sites") >= least), "recurring-forms")
    recurring = entries.join(small_side(spread.drop("sites"), spread.count()), ["h", "is_title"])
    per_page = recurring.groupBy("page_id", "words", "filler_words").agg(F.sum("n").alias("said"), F.max("is_title").alias("titled"))
    by_form = per_page.select("page_id", F.when(F.col("titled"), "title").when((F.col("said") > 0) & (F.col("said") + F.col("filler_words") >= share * F.col("words")), "message").alias("reason"))
    alone = seen.select("page_id", F.when(F.col("unfilled") > 0, "placeholder").when((F.col("filler_words") > 0) & (F.col("filler_words") >= share * F.col("words")), "filler").alias("reason"))
    return by_form.unionByName(alone).where("reason is not null").groupBy("page_id").agg(F.max("reason").alias("reason"))


def without_residue(pages: DataFrame, id_col="page_id", **options) -> DataFrame:
    """The input rows, all columns, without the pages found."""
    bad = residue_pages(pages, id_col, **options).select(F.col("page_id").alias("_bad"))
    return pages.join(bad, F.col(id_col) == F.col("_bad"), "left_anti")
