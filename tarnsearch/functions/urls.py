"""Resolving and canonicalising links in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnsearch.functions.expr import let

# Query parameters that name a campaign and not a resource.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_eid")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def _reencode(pair: Column) -> Column:
    """A query pair in form encoding: decoded, then encoded again."""
    one = lambda s: F.url_encode(F.coalesce(F.try_url_decode(s), s))
    eq = F.locate("=", pair)
    return F.when(eq > 0, F.concat(one(pair.substr(F.lit(1), eq - 1)), F.lit("="), one(pair.substr(eq + 1, F.length(pair))))).otherwise(F.concat(one(pair), F.lit("=")))


def clean_query(query: Column) -> Column:
    """Query without tracking parameters, the kept pairs encoded anew; null when nothing is left."""
    names = F.array(*[F.lit(t) for t in TRACKING])
    name = lambda p: F.when(p.contains("%"), F.coalesce(F.try_url_decode(F.split(p, "=")[0]), F.lit(""))).otherwise(F.split(p, "=")[0])
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(names, name(p)))
    joined = F.array_join(F.transform(kept, _reencode), "&")
    return F.when(joined != "", joined)


def remove_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments, encoded ones included."""
    dots = lambda s: F.when(s.rlike(r"(?i)^(?:%2e|\.){1,2}$"), F.regexp_replace(s, "(?i)%2e", ".")).otherwise(s)
    segments = F.when(path.rlike("(?i)%2e"), F.transform(F.split(path, "/"), dots)).otherwise(F.split(path, "/"))
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    out = F.array_join(kept, "/")
    out = F.when(last.isin(".", ".."), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def encode_path(path: Column) -> Column:
    """Percent-encode what a path may not hold: blanks, controls, quotes, brackets and everything beyond ASCII."""
    special = r"[^\x21-\x7e]|[\"<>`{}]"
    one = lambda c: F.when(c.rlike(special), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(path.rlike(special), F.array_join(F.transform(F.split(path, ""), one), "")).otherwise(path)


def tidy(url: Column) -> Column:
    """Without tabs and line breaks, which links don't hold; a backslash before the query is a slash."""
    flat = F.regexp_replace(F.trim(url), r"[\t\n\r]", "")
    at = F.regexp_instr(flat, F.lit("[?#]"))
    front = F.when(at > 0, F.substr(flat, F.lit(1), at - 1)).otherwise(flat)
    slashed = F.concat(F.translate(front, "\\", "/"), F.when(at > 0, F.substr(flat, at)).otherwise(""))
    return F.trim(F.when(url.rlike(r"[\t\n\r\\]"), slashed).otherwise(url))


def canonical(url: Column) -> Column:
    """Canonical form of an absolute URL: http(s) only, no fragment, no default port, no trailing host dot, no tracking."""
    return let(tidy(url), _canonical)


def _canonical(url: Column) -> Column:
    scheme = F.lower(_part(url, 1))
    authority = F.regexp_replace(F.lower(_part(url, 2)), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.$", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = let(remove_dots(_part(url, 3)), encode_path)
    query = F.coalesce(let(clean_query(_part(url, 4)), lambda q: F.concat(F.lit("?"), q)), F.lit(""))
    whole = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), path, query)
    return F.when(scheme.isin("http", "https") & (host != ""), whole)


def resolve(base: Column, href: Column) -> Column:
    """Absolute canonical form of ``href`` found on the page ``base``; null for fragments, other schemes and malformed links."""
    return let(F.struct(tidy(href).alias("href"), tidy(base).alias("base")), lambda x: _resolve(x["base"], x["href"]))


def _resolve(base: Column, href: Column) -> Column:
    scheme, authority, path, query = (_part(base, n) for n in (1, 2, 3, 4))
    origin = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"^(.*/)", 1)
    absolute = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(href.rlike(r"^(?i:https?)://[^/?#]"), href))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, folder, href))
    )
    return F.when((href != "") & ~href.startswith("#"), canonical(absolute))
