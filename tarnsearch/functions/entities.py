"""HTML entities as one left-to-right pass of column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that are decoded besides amp, lt, gt, quot, apos and nbsp; their characters are those of the HTML standard.
NAMES = """
aacute eacute iacute oacute uacute Aacute Eacute Iacute Oacute Uacute agrave egrave igrave ograve ugrave Agrave Egrave Igrave Ograve Ugrave
acirc ecirc icirc ocirc ucirc Acirc Ecirc Icirc Ocirc Ucirc auml euml iuml ouml uuml Auml Euml Iuml Ouml Uuml
atilde otilde ntilde Atilde Otilde Ntilde ccedil Ccedil aring Aring aelig AElig oslash Oslash yacute yuml szlig
iexcl iquest laquo raquo deg middot ndash mdash hellip lsquo rsquo ldquo rdquo euro pound yen cent copy reg times divide plusmn frac12 sup2
""".split()

#: Bytes from the ampersand within which the semicolon has to stand.
WINDOW = 12


def table() -> dict[str, str]:
    known = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
    known.update({n: chr(name2codepoint[n]) for n in NAMES})
    return known


def _character(code: Column) -> Column:
    """Code point to character; no-break space becomes a plain one, an impossible code null."""
    valid = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code == 160, " ").when(valid, char)


def decode_entities(col: Column) -> Column:
    """Replace entities in one pass, so ``&amp;lt;`` gives ``&lt;``; what is not known stays as it is."""
    names = F.create_map(*[F.lit(x) for pair in table().items() for x in pair])

    def piece(p: Column) -> Column:
        end = F.locate(";", p)
        name = F.substring(p, 1, end - 1) if isinstance(end, int) else p.substr(F.lit(1), end - 1)
        rest = p.substr(end + 1, F.length(p))
        decimal = F.when(name.rlike("^#[0-9]{1,9}$"), F.expr("1") * F.try_to_number(F.regexp_extract(name, "^#([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"))
        hexadecimal = F.when(name.rlike("^#[xX][0-9a-fA-F]{1,8}$"), F.conv(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,8})$", 1), 16, 10).cast("long"))
        char = F.coalesce(F.try_element_at(names, name), _character(F.coalesce(decimal, hexadecimal)))
        near = (end > 1) & (F.octet_length(name) + 1 <= WINDOW - 1)
        return F.when(near & char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), p))

    parts = F.split(col, "&")
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(tail, piece), ""))
