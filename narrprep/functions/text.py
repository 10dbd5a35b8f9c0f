"""Cleaning functions for text damaged by extraction (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .charclass import LINE_SPACE, NON_SPACE, SPACE, WORD

# Typographic ligatures and the letters they stand for.
LIGATURES = {
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}

# Typographic characters and their plain form.
PLAIN_CHARACTERS = {
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": "-",
    "\u2014": " - ",
    "\u2026": "...",
    "\u00a0": " ",
    "\u00ad": "",
    "\ufeff": "",
}


def _replace_each(c: Column, table: dict[str, str]) -> Column:
    """Replace single characters by fixed texts, in texts that hold one of them."""

    def replaced(t: Column) -> Column:
        for old, new in table.items():
            t = F.replace(t, F.lit(old), F.lit(new))
        return t

    any_old = "[" + "".join(rf"\x{{{ord(old):x}}}" for old in table) + "]"
    # Nearly all characters are below the table's or between two groups of it.
    low, high = (f(ord(old) for old in table) for f in (min, max))
    return let(c, lambda t: F.when(t.rlike(rf"[\x{{{low:x}}}-\x{{{high:x}}}&&{any_old}]"), replaced(t)).otherwise(t))


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends.

    Only the ends are looked at: the text between its first and its last
    character that is not white space.
    """
    return F.regexp_extract(c, rf"(?s)\A{SPACE}*+({NON_SPACE}(?:.*{NON_SPACE})?)?", 1)


def replace_ligatures(c: Column) -> Column:
    return _replace_each(c, LIGATURES)


def plain_characters(c: Column) -> Column:
    return _replace_each(c, PLAIN_CHARACTERS)


def _where(c: Column, marks: list[str], change) -> Column:
    """Apply ``change`` to texts that hold one of ``marks``.

    A byte search is far cheaper than a pass of a regular expression, and
    most texts hold none of the marks of most rules.
    """

    def guarded(t: Column) -> Column:
        present = F.contains(t, F.lit(marks[0]))
        for mark in marks[1:]:
            present = present | F.contains(t, F.lit(mark))
        return F.when(present, change(t)).otherwise(t)

    return let(c, guarded)


def rejoin_hyphenated(c: Column) -> Column:
    """Join a word cut by a hyphen at a line end, also across blank lines.

    The word behind the break is consumed, so of two cuts in a row
    (``a-⏎b-⏎c``) only the first is joined.
    """
    # The hyphen stands first and is looked back from: a search for one character is the fastest.
    # A look-behind counts a character outside the basic plane as one where it takes two.
    before = rf"(?<={WORD}-|(?={WORD})[\x{{10000}}-\x{{10FFFF}}][^-]?-)"
    cut = rf"-{before}(?<!\G-){SPACE}*\n{SPACE}*({WORD}++)"
    return _where(c, ["-"], lambda t: F.regexp_replace(t, cut, "$1"))


def drop_page_artifacts(c: Column) -> Column:
    """Drop lines that hold only a page number, ``Page N`` or a ruler.

    A newline is put in front so that every line, the first one too, goes
    together with the newline before it.
    """
    artifact = (
        rf"(?i)\n{LINE_SPACE}*+(?:(?:Page{LINE_SPACE}+)?\p{{Nd}}+|[-_=]{{3,}})"
        rf"{LINE_SPACE}*+(?=\n|\z)"
    )
    return F.substr(F.regexp_replace(F.concat(F.lit("\n"), c), artifact, ""), F.lit(2))


def space_numbers(c: Column) -> Column:
    """Space after a currency sign; commas between the groups of a phone number."""
    c = _where(c, ["$", "€"], lambda t: F.regexp_replace(t, r"([$€])(?=\p{Nd})", "$1 "))
    phone = r"(\p{Nd}{3})-(\p{Nd}{3})-(\p{Nd}{4})"
    return _where(c, ["-"], lambda t: F.regexp_replace(t, phone, "$1, $2, $3"))


def normalize_punctuation(c: Column) -> Column:
    c = _where(c, [".."], lambda t: F.regexp_replace(t, r"\.{2,}", "..."))
    c = _where(c, ["!!"], lambda t: F.regexp_replace(t, r"!{2,}", "!"))
    c = _where(c, ["??"], lambda t: F.regexp_replace(t, r"\?{2,}", "?"))
    c = F.regexp_replace(c, r"([.!?])(?=[A-Za-z])", "$1 ")
    # White space around a parenthesis, paragraph breaks included, is one space.
    run = rf"{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+"
    opening = rf"{run}\({SPACE}*+|\({SPACE}*+"
    closing = rf"{run}\){SPACE}*+|\){SPACE}*+"
    c = _where(c, ["("], lambda t: F.regexp_replace(t, opening, " ("))
    c = _where(c, [")"], lambda t: F.regexp_replace(t, closing, ") "))
    return _where(c, [";"], lambda t: F.replace(t, F.lit(";"), F.lit(".")))


def normalize_whitespace(c: Column) -> Column:
    c = _where(c, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    c = _where(c, ["\n"], lambda t: F.regexp_replace(t, r"\n(?<!\n\n)(?!\n)", " "))
    # A single space stays as it is, so only longer runs and tabs are found.
    blanks = r"[ \t](?:(?=[ \t])|(?<=\t))[ \t]*+"
    c = _where(c, ["  ", "\t"], lambda t: F.regexp_replace(t, blanks, " "))
    c = _where(c, [" \n\n", "\n\n "], lambda t: F.regexp_replace(t, r" ?\n\n ?", "\n\n"))
    return strip(c)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"{NON_SPACE}++"))


def file_label(c: Column) -> Column:
    """Text usable as a file or partition name, at most 100 characters."""
    c = F.regexp_replace(c, r'[<>:"/\\|?*]', "")
    return F.substring(F.regexp_replace(c, rf"{SPACE}+", "_"), 1, 100)


def preview(c: Column, max_chars: int) -> Column:
    return F.when(
        F.length(c) > max_chars, F.concat(F.substring(c, 1, max_chars), F.lit("..."))
    ).otherwise(c)


def text_slice(c: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (0-based, inclusive) to ``end`` (exclusive)."""
    return F.substr(c, (start + F.lit(1)).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """Extension with its dot, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+$", "")


def without_fragment(url: Column) -> Column:
    return F.split(url, "#", 2)[0]


def strip_export_header(c: Column) -> Column:
    """Body of a text file written by the text export, header blocks removed.

    Only the ``TEXT`` title between two rulers ends the header, so a body that
    holds the word itself is kept whole.
    """
    ruler = "={60}"
    body = F.regexp_replace(c, rf"(?s)\A{ruler}\n(?:METADATA|TEXT)\n.*?(?<=\n|\A){ruler}\nTEXT\n{ruler}\n+", "")
    only_text = F.regexp_replace(c, rf"(?s)\A{ruler}\nTEXT\n{ruler}\n+", "")
    return F.when(c.rlike(rf"\A{ruler}\nTEXT\n{ruler}\n"), only_text).otherwise(body)


def progress_line(stage: Column, percent: Column, message: Column, chapter: Column) -> Column:
    return F.when(
        F.coalesce(chapter, F.lit("")) != "",
        F.format_string("[%s] %.1f%% - %s: %s", stage, percent, chapter, message),
    ).otherwise(F.format_string("[%s] %.1f%% - %s", stage, percent, message))
