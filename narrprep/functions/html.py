"""HTML section -> text, without a parser in the row path."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .charclass import INLINE_SPACE, LINE_BREAK, SPACE
from .text import strip


def _named_entities() -> Column:
    """Map of entity names, from the standard table, as one constant."""
    table = {
        name[:-1]: text
        for name, text in html.entities.html5.items()
        if name.endswith(";") and text != "&"
    }
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


_AMPERSAND = r"&(?:amp|AMP|#0*38|#[xX]0*26);"
_CODE = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
_NAME = r"&([A-Za-z][A-Za-z0-9]*);"


def _replace_named(t: Column) -> Column:
    names = F.array_except(
        F.array_distinct(F.regexp_extract_all(t, F.lit(_NAME), F.lit(1))), F.array(F.lit("amp"), F.lit("AMP"))
    )
    table = _named_entities()
    return F.aggregate(
        names,
        t,
        lambda acc, name: F.coalesce(
            F.replace(acc, F.concat(F.lit("&"), name, F.lit(";")), F.try_element_at(table, name)), acc
        ),
    )


def _windows(number: Column) -> Column:
    """Codes 128 to 159 read as the Windows code page, as browsers do; null for all others."""
    page = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in page.items() if pair[1] for x in pair]), number)


def _replace_codes(t: Column) -> Column:
    codes = F.filter(
        F.array_distinct(F.regexp_extract_all(t, F.lit(_CODE), F.lit(0))),
        lambda code: ~code.rlike(_AMPERSAND),
    )

    def character(code: Column) -> Column:
        digits = F.regexp_extract(code, r"&#[xX]?([0-9A-Fa-f]+);", 1)
        base16 = F.when(code.rlike("&#[xX]"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
        bare = F.regexp_replace(base16, "^0+", "")
        number = F.when(F.length(bare) <= 6, F.conv(bare, 16, 10).cast("int"))
        exists = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # A code that no character has reads as the replacement character.
        known = F.when(exists, F.decode(F.unhex(F.lpad(bare, 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.coalesce(_windows(number), known)

    return F.aggregate(codes, t, lambda acc, code: F.replace(acc, code, character(code)))


def unescape(c: Column) -> Column:
    """Named and numeric character references, each replaced once.

    Only the references a row holds are looked up.  The ampersand itself goes
    last, so that ``&amp;lt;`` becomes ``&lt;`` and not ``<``.
    """

    def all_of(t: Column) -> Column:
        numeric = let(_replace_named(t), lambda u: F.when(F.contains(u, F.lit("&#")), _replace_codes(u)).otherwise(u))
        return F.when(
            F.contains(t, F.lit("&")), F.regexp_replace(numeric, _AMPERSAND, "&")
        ).otherwise(t)

    return let(c, all_of)


def html_to_text(c: Column) -> Column:
    """Text nodes of a page, one paragraph each.

    Scripts, styles, comments and tags each end a text node; lines are
    stripped, empty ones dropped and the rest joined by a blank line.
    """
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>", "\n")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "\n")
    # A ">" inside a quoted attribute does not end the tag; tags with a stray quote end at the first one.
    c = F.regexp_replace(c, r"""<[A-Za-z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", "\n")
    c = F.regexp_replace(c, r"<[A-Za-z/!?][^>]*+>", "\n")
    c = unescape(c)
    breaks = rf"(?<!{INLINE_SPACE}){INLINE_SPACE}*+{LINE_BREAK}{SPACE}*+"
    return strip(F.regexp_replace(c, breaks, "\n\n"))


def page_title(c: Column) -> Column:
    title = F.regexp_extract(c, r"(?is)<title[^>]*+>(.*?)</title\s*+>", 1)
    return strip(unescape(title))


def meta_value(c: Column, name: str) -> Column:
    """``content`` of a ``<meta name=…>`` element; empty when it is missing."""
    tags = F.regexp_extract_all(c, F.lit(r"""(?is)<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    named = F.get(F.filter(tags, lambda tag: tag.rlike(rf"""(?is)\sname\s*=\s*["']?{name}["'\s/>]""")), 0)
    double = F.regexp_extract(named, r"""(?is)\scontent\s*=\s*"([^"]*)\"""", 1)
    single = F.regexp_extract(named, r"""(?is)\scontent\s*=\s*'([^']*)'""", 1)
    return strip(unescape(F.coalesce(F.nullif(double, F.lit("")), single, F.lit(""))))
