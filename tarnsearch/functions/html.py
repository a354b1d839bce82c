"""Title, text, links, base and robots directives of an HTML page, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnsearch.functions.entities import decode_entities
from tarnsearch.functions.expr import let

# Elements whose content is no text, and elements that separate words.
SKIPPED = ("script", "style", "noscript", "template", "svg")
BLOCKS = ("p", "div", "br", "li", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "blockquote")

_VANISH = r"(?is)<!--.*?(?:-->|\z)|<!(?!--)[^>]*>|<(" + "|".join(SKIPPED) + r")(?![a-z0-9])[^>]*>.*?(?:</\1[^>]*>|\z)"
_BLOCK = r"(?is)</?(?:" + "|".join(BLOCKS) + r")(?![a-z0-9])[^>]*>"
_TAG = r"(?s)<[^>]*>"
_ANCHOR = r"(?is)(<a(?![a-z0-9])[^>]*>.*?)(?=</a(?![a-z0-9])|<a(?![a-z0-9])|\z)"


def collapse(col: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(col, r"(?U)\s+", " ")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag: quoted either way or bare; null when there is none."""
    # a quote that isn't closed takes the rest of the tag
    pattern = r"(?is)[\s\"']" + name + r"\s*=\s*(?:\"([^\"]*?)(?:\"|>?\z)|'([^']*?)(?:'|>?\z)|([^\s>\"']+))"
    bare = F.regexp_replace(F.regexp_extract(tag, pattern, 3), "/+$", "")
    quoted = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.when(tag.rlike(pattern), F.concat(quoted, bare))


def visible(html: Column) -> Column:
    """The page without comments, declarations and elements that hold no text (H1, H2)."""
    return F.regexp_replace(html, _VANISH, "")


def plain(markup: Column) -> Column:
    """Text of cleaned markup: block tags separate, other tags vanish, blanks collapse (H3-H5)."""
    return collapse(F.regexp_replace(F.regexp_replace(markup, _BLOCK, " "), _TAG, ""))


def extract(html: Column) -> Column:
    """STRUCT<title, text, links ARRAY<STRUCT<href, text>>, base, noindex, nofollow>; null for a null page."""
    return F.when(html.isNotNull(), let(visible(html), _extract))


def _extract(clean: Column) -> Column:
    title = F.trim(decode_entities(collapse(F.regexp_replace(F.regexp_extract(clean, r"(?is)<title(?![a-z0-9])[^>]*>(.*?)(?:</title|\z)", 1), _TAG, ""))))
    text = decode_entities(F.trim(plain(clean)))
    anchors = F.filter(
        F.transform(
            F.regexp_extract_all(clean, F.lit(_ANCHOR), F.lit(1)),
            lambda a: let(
                F.regexp_extract(a, r"(?s)^(<[^>]*>)", 1),
                lambda tag: F.struct(F.trim(decode_entities(attribute(tag, "href"))).alias("href"), F.trim(decode_entities(plain(a))).alias("text"), F.coalesce(F.lower(attribute(tag, "rel")), F.lit("")).alias("rel")),
            ),
        ),
        lambda s: s["href"].isNotNull() & ~s["rel"].contains("nofollow"),
    )
    links = F.transform(anchors, lambda s: F.struct(s["href"].alias("href"), s["text"].alias("text")))
    base = attribute(F.try_element_at(F.filter(F.regexp_extract_all(clean, F.lit(r"(?is)(<base(?![a-z0-9])[^>]*>)"), F.lit(1)), lambda t: attribute(t, "href").isNotNull()), F.lit(1)), "href")
    metas = F.filter(F.regexp_extract_all(clean, F.lit(r"(?is)(<meta(?![a-z0-9])[^>]*>)"), F.lit(1)), lambda t: F.lower(F.coalesce(attribute(t, "name"), F.lit(""))) == "robots")
    rules = F.transform(metas, lambda t: F.lower(F.coalesce(attribute(t, "content"), F.lit(""))))
    has = lambda word: F.exists(rules, lambda r: r.contains(word) | r.contains("none"))
    return F.struct(title.alias("title"), text.alias("text"), links.alias("links"), base.alias("base"), has("noindex").alias("noindex"), has("nofollow").alias("nofollow"))


def page_title(title: Column, fallback: Column) -> Column:
    """The page's own title, else the fallback."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), fallback)
