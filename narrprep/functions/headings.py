"""Chapter headings: recognition, titles and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charclass import LINE_SPACE, RIGHT_EDGE, SPACE
from .numbers import chapter_number
from .text import strip

# Words that open a numbered heading, and the prefix of its title.
NUMBERED = {
    "Chapter": "Chapter",
    "Part": "Part",
    "Capítulo": "Capítulo",
    "Capitulo": "Capítulo",
    "Parte": "Parte",
}

# Words that are a heading by themselves.
UNNUMBERED = [
    "Prologue",
    "Epilogue",
    "Introduction",
    "Conclusion",
    "Preface",
    "Foreword",
    "Afterword",
    "Prólogo",
    "Prologo",
    "Epílogo",
    "Epilogo",
    "Introducción",
    "Introduccion",
    "Conclusión",
    "Prefacio",
]

_NUMERAL = r"(?:\p{Nd}+|[IVXLC]+)"
_REST = rf"{SPACE}*[:\-.]?{SPACE}*(.*)\z"


def _edge(compat: bool) -> str:
    return "" if compat else RIGHT_EDGE


def _numbered(space: str, compat: bool) -> str:
    return rf"({'|'.join(NUMBERED)}){space}+({_NUMERAL}){_edge(compat)}"


def _unnumbered(compat: bool) -> str:
    return rf"({'|'.join(UNNUMBERED)}){_edge(compat)}"


def heading_start(compat: bool = False) -> str:
    """Zero-width pattern at the start of every heading line.

    With ``compat`` no word boundary is asked for behind the numeral or word,
    so that ``Introductions`` and ``Chapter Long`` count as headings.
    """
    body = f"(?:{_numbered(LINE_SPACE, compat)}|{_unnumbered(compat)})"
    return rf"(?iu)(?<![^\n])(?={LINE_SPACE}*+{body})"


def split_at_headings(text: Column, compat: bool = False) -> Column:
    """Text before the first heading (if any), then one piece per heading."""
    return F.split(text, heading_start(compat))


def heading_fields(line: Column, compat: bool = False) -> Column:
    """Struct(title, number) of a stripped line; null when it is no heading."""
    flags = r"(?isu)\A"
    numbered = flags + _numbered(SPACE, compat) + _REST
    plain = flags + _unnumbered(compat) + _REST
    word = F.lower(F.regexp_extract(line, numbered, 1))
    prefix = F.lit(None).cast("string")
    for name, shown in NUMBERED.items():
        prefix = F.when(word == name.lower(), F.lit(shown)).otherwise(prefix)
    numeral = F.regexp_extract(line, numbered, 2)
    subtitle = strip(F.regexp_extract(line, numbered, 3))
    numbered_title = F.concat(
        prefix, F.lit(" "), numeral, F.when(subtitle != "", F.concat(F.lit(": "), subtitle)).otherwise("")
    )
    plain_word = F.regexp_extract(line, plain, 1)
    plain_rest = strip(F.regexp_extract(line, plain, 2))
    plain_title = F.concat(
        plain_word, F.when(plain_rest != "", F.concat(F.lit(": "), plain_rest)).otherwise("")
    )
    no_number = F.lit(None).cast("int")
    return F.when(
        line.rlike(numbered),
        F.struct(numbered_title.alias("title"), chapter_number(numeral).alias("number")),
    ).when(line.rlike(plain), F.struct(plain_title.alias("title"), no_number.alias("number")))


def first_line(piece: Column) -> Column:
    return strip(F.substring_index(piece, "\n", 1))
