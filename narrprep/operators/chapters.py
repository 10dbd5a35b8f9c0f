"""Chapter detection: headings, spans, tables of contents and assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, running_offsets, slices
from ..functions.headings import first_line, heading_fields, split_at_headings
from .scan import asof_backward, number_block, ordered_scan

MIN_CHAPTER_LENGTH = 500
BLOCK_CHARS = 4_000_000


def _pieces(text: Column, compat: bool, body) -> Column:
    """Call ``body(pieces, starts)`` with the heading pieces of a text and their offsets."""

    def from_split(parts: Column) -> Column:
        opens = let(first_line(parts[0]), lambda line: heading_fields(line, compat)).isNotNull()
        pieces = F.when(opens, parts).otherwise(F.slice(parts, F.lit(2), F.size(parts)))
        first = F.when(opens, F.lit(0)).otherwise(F.length(parts[0]))
        return let(
            F.struct(pieces.alias("p"), first.alias("f")),
            lambda x: let(
                running_offsets(F.transform(x["p"], F.length), 0, x["f"]),
                lambda starts: body(x["p"], starts),
            ),
        )

    return let(split_at_headings(text, compat), from_split)


def heading_array(text: Column, compat: bool = False) -> Column:
    """Array of (title, number, start_char) of every heading line of a text."""

    def body(pieces: Column, starts: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            return let(
                let(first_line(piece), lambda line: heading_fields(line, compat)),
                lambda h: F.struct(
                    h["title"].alias("title"), h["number"].alias("number"), starts[i].alias("start_char")
                ),
            )

        return F.transform(pieces, one)

    return _pieces(text, compat, body)


def chapter_array(text: Column, min_length: int = MIN_CHAPTER_LENGTH, compat: bool = False) -> Column:
    """Array of (title, number, start_char, end_char, chapter_text) of a text.

    A chapter shorter than ``min_length`` is dropped when the text has two or
    more headings; its text then belongs to the chapter before it.
    """

    def body(pieces: Column, starts: Column) -> Column:
        place = F.transform(
            pieces, lambda p, i: F.struct((i + 1).cast("bigint").alias("at"), F.length(p).alias("n"))
        )
        kept = F.transform(
            F.filter(place, lambda x: (F.size(pieces) <= 1) | (x["n"] >= min_length)), lambda x: x["at"]
        )

        def chapter(parts: Column, start: Column) -> Column:
            return let(
                F.struct(
                    let(first_line(parts[0]), lambda line: heading_fields(line, compat)).alias("h"),
                    F.array_join(parts, "").alias("t"),
                    start.alias("s"),
                ),
                lambda x: F.struct(
                    x["h"]["title"].alias("title"),
                    x["h"]["number"].alias("number"),
                    x["s"].alias("start_char"),
                    (x["s"] + F.length(x["t"])).alias("end_char"),
                    x["t"].alias("chapter_text"),
                ),
            )

        return let(
            kept,
            lambda at: F.transform(
                slices(pieces, at), lambda parts, k: chapter(parts, F.element_at(starts, at[k].cast("int")))
            ),
        )

    return _pieces(text, compat, body)


def headings(
    df: DataFrame, keys: Sequence[str], text: str = "text", compat: bool = False
) -> DataFrame:
    """One row per heading line of every text: ordinal, offset, title, number."""
    return df.select(
        *keys,
        F.length(text).cast("bigint").alias("text_chars"),
        F.posexplode(heading_array(F.col(text), compat)).alias("i", "h"),
    ).select(
        *keys,
        (F.col("i") + 1).cast("int").alias("heading_no"),
        "h.start_char",
        "h.title",
        "h.number",
        "text_chars",
    )


def document_chapters(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    min_length: int = MIN_CHAPTER_LENGTH,
    compat: bool = False,
    keep_text: bool = True,
) -> DataFrame:
    """One row per chapter of texts that are one row each, without a shuffle."""
    fields = ["title", "number", "start_char", "end_char"] + (["chapter_text"] if keep_text else [])
    found = chapter_array(F.col(text), min_length, compat)
    return df.select(*keys, F.posexplode(found).alias("i", "c")).select(
        *keys, (F.col("i") + 1).cast("int").alias("chapter_no"), *[F.col(f"c.{f}") for f in fields]
    )


def chapter_spans(
    found: DataFrame,
    keys: Sequence[str],
    total_chars: str = "text_chars",
    min_length: int = MIN_CHAPTER_LENGTH,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Spans of headings in long form, for books whose text is many rows.

    Length is measured to the next heading of any length; the end is the next
    heading that was kept.
    """
    block = number_block("start_char", block_chars)
    order = ["start_char", "title"]
    measured = ordered_scan(
        found, keys, order, block,
        following={"__next": F.col("start_char")},
        group_sum={"__n": F.lit(1)},
    )
    end = F.coalesce(F.col("__next"), F.col(total_chars))
    kept = measured.filter(
        (F.col("__n") <= 1) | (end - F.col("start_char") >= min_length)
    ).drop("__next", "__n")
    spans = ordered_scan(
        kept, keys, order, block,
        following={"__next": F.col("start_char")},
        sum_before={"__before": F.lit(1)},
    )
    return spans.withColumn("end_char", end).withColumn(
        "chapter_no", (F.col("__before") + 1).cast("int")
    ).drop("__next", "__before")


def assign_chapters(
    positions: DataFrame,
    chapters: DataFrame,
    keys: Sequence[str],
    position: str,
    block_chars: int = BLOCK_CHARS,
    n_rows: int = 0,
) -> DataFrame:
    """Chapter that holds every position; null before the first chapter.

    Spans do not overlap, so the chapter is the last one that starts at or
    before the position, if it has not ended.  ``n_rows`` is the number of
    positions, if known.
    """
    found = asof_backward(
        positions, chapters, keys, position, "start_char", ["chapter_no", "end_char"], block_chars, n_rows
    )
    inside = F.col("end_char").isNull() | (F.col(position) < F.col("end_char"))
    return found.withColumn("chapter_no", F.when(inside, F.col("chapter_no"))).drop("end_char")


def top_entries(toc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level 1 entries of a table of contents; up to level 2 where there is none."""
    has_top = toc.groupBy(*keys).agg(F.min("level").alias("__min_level"))
    return (
        toc.join(has_top, list(keys))
        .filter(F.when(F.col("__min_level") == 1, F.col("level") == 1).otherwise(F.col("level") <= 2))
        .drop("__min_level")
    )


def toc_starts(
    toc: DataFrame, offsets: DataFrame, keys: Sequence[str], block_sections: int = 4096
) -> DataFrame:
    """Offset of the section every entry points to.

    A section that is missing takes the offset of the one before it, or 0.
    """
    right = offsets.select(*keys, F.col("section_num").alias("__section"), "char_offset")
    found = asof_backward(toc, right, keys, "section_num", "__section", ["char_offset"], block_sections)
    return found.withColumn("start_char", F.coalesce("char_offset", F.lit(0).cast("bigint"))).drop("char_offset")


def toc_or_headings(toc_chapters: DataFrame, pattern_chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chapters of the table of contents; headings for books without one."""
    rest = pattern_chapters.join(toc_chapters.select(*keys).distinct(), list(keys), "left_anti")
    return toc_chapters.unionByName(rest, allowMissingColumns=True)


def select_chapters(chapters: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chapters asked for by number; numbers that do not exist give no rows."""
    return chapters.join(requests.select(*keys, "chapter_no").distinct(), [*keys, "chapter_no"], "left_semi")


def selected_text(text: Column, wanted: Column, min_length: int = MIN_CHAPTER_LENGTH) -> Column:
    """Text of the chapters whose numbers are in the array ``wanted``, joined by a blank line.

    Null when none of them exists: a request for missing chapters is not a
    request for the whole book.
    """
    found = F.filter(
        chapter_array(text, min_length), lambda c, i: F.array_contains(wanted, (i + F.lit(1)).cast("int"))
    )
    return let(
        found,
        lambda cs: F.when(F.size(cs) > 0, F.array_join(F.transform(cs, lambda c: c["chapter_text"]), "\n\n")),
    )


def rebase_selected(chapters: DataFrame, keys: Sequence[str], block_chapters: int = 65_536) -> DataFrame:
    """Spans of selected chapters within their joined text instead of the whole book."""
    scanned = ordered_scan(
        chapters, keys, ["chapter_no"], number_block("chapter_no", block_chapters),
        sum_before={"__start": F.col("end_char") - F.col("start_char") + F.lit(2)},
    )
    return (
        scanned.withColumn("end_char", F.col("__start") + F.col("end_char") - F.col("start_char"))
        .withColumn("start_char", F.col("__start"))
        .drop("__start")
    )


def chapter_by_number(chapters: DataFrame, number: int | Column) -> DataFrame:
    wanted = number if isinstance(number, Column) else F.lit(number)
    return chapters.filter(F.col("number") == wanted)
