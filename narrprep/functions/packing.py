"""Sentence splitting and greedy packing inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import group_starts, let, slices
from .charclass import SPACE
from .text import strip

# Words at which a long sentence may be cut.
CONJUNCTIONS = ["and", "or", "but", "because", "while", "when"]

_BREAK = rf"[,;]{SPACE}+|{SPACE}+(?:{'|'.join(CONJUNCTIONS)}){SPACE}+"


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, "\n\n+"), strip), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Sentences of one paragraph, cut behind ``.``, ``!`` or ``?`` and closing marks.

    A paragraph holds no blank line, so a blank line can mark the cuts.
    """
    marked = F.regexp_replace(paragraph, rf"([.!?][\"')\]]*+){SPACE}++", "$1\n\n")
    return F.filter(F.transform(F.split(marked, "\n\n"), strip), lambda s: s != "")


def _items(texts: Column) -> Column:
    return F.transform(
        texts, lambda t: F.struct(t.alias("t"), F.length(t).alias("n"), F.lit(False).alias("solo"))
    )


def _joined(group: Column, glue: str) -> Column:
    return F.array_join(F.transform(group, lambda x: x["t"]), glue)


def force_split(piece: Column, max_chars: int, compat: bool = False) -> Column:
    """Cut at words; a single longer word stays whole.

    ``compat`` counts one character too many in the first part.
    """
    words = F.filter(F.split(piece, rf"{SPACE}+"), lambda w: w != "")
    return let(
        _items(words),
        lambda items: let(
            group_starts(
                items, lambda cur, x: cur + 1 + x["n"] > max_chars, 1, first_extra=1 if compat else 0
            ),
            lambda starts: F.transform(slices(items, starts), lambda g: _joined(g, " ")),
        ),
    )


def split_long(sentence: Column, max_chars: int, compat: bool = False) -> Column:
    """Parts of a sentence that is longer than ``max_chars``.

    Cut behind a comma or semicolon or around a conjunction, separators kept,
    packed greedily; parts that are still too long are cut at words.
    """
    marks = F.regexp_extract_all(sentence, F.lit(_BREAK), F.lit(0))
    texts = F.split(sentence, _BREAK)
    parts = let(
        marks,
        lambda m: F.filter(
            F.flatten(
                F.transform(
                    texts, lambda t, i: F.array(t, F.coalesce(F.try_element_at(m, i + F.lit(1)), F.lit("")))
                )
            ),
            lambda t: t != "",
        ),
    )
    packed = let(
        _items(parts),
        lambda items: let(
            group_starts(items, lambda cur, x: cur + x["n"] > max_chars, 0),
            lambda starts: F.transform(slices(items, starts), lambda g: strip(_joined(g, ""))),
        ),
    )
    return F.flatten(
        F.transform(
            packed,
            lambda p: F.when(F.length(p) > max_chars, force_split(p, max_chars, compat)).otherwise(F.array(p)),
        )
    )


def sentence_pieces(paragraph: Column, max_chars: int, compat: bool = False) -> Column:
    """Array of (t, n, solo): sentences, and the parts of those that are too long."""

    def pieces(s: Column) -> Column:
        whole = F.array(F.struct(s.alias("t"), F.length(s).alias("n"), F.lit(False).alias("solo")))
        cut = F.transform(
            split_long(s, max_chars, compat),
            lambda p: F.struct(p.alias("t"), F.length(p).alias("n"), F.lit(True).alias("solo")),
        )
        return F.when(F.length(s) > max_chars, cut).otherwise(whole)

    return F.flatten(F.transform(sentences(paragraph), pieces))


def pack_starts(pieces: Column, max_chars: int) -> Column:
    """Where chunks of at most ``max_chars`` open; parts of long sentences stand alone."""
    return group_starts(
        pieces, lambda cur, x: cur + 1 + x["n"] > max_chars, 1, solo=lambda x: x["solo"]
    )


def merge_starts(chunks: Column, min_chars: int, max_chars: int) -> Column:
    """Where merged chunks open: a chunk below ``min_chars`` takes in the next one if it fits."""
    return group_starts(
        chunks,
        lambda cur, x: ~((cur < min_chars) & (cur + 1 + x["n"] <= max_chars)),
        1,
    )
