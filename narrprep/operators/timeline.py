"""Timelines and chapter markers in whole samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import (
    CHAPTER_PAUSE,
    PARAGRAPH_PAUSE,
    SAMPLE_RATE,
    samples_clock,
    samples_millis,
    silence_samples,
    spoken_samples,
)
from ..functions.text import word_count
from .scan import BLOCK, FAN, cell_of, dealt_cells, number_block, ordered_scan

BLOCK_ROWS = 65_536


def with_durations(chunks: DataFrame, text: str = "text", speed: float | Column = 1.0) -> DataFrame:
    """Word count and estimated samples of every chunk; blank text gives none."""
    return chunks.withColumn("n_words", word_count(F.col(text))).withColumn(
        "n_samples", spoken_samples(F.col("n_words"), speed)
    )


def timeline(
    chunks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None = None,
    paragraph_pause: float = PARAGRAPH_PAUSE,
    chapter_pause: float = CHAPTER_PAUSE,
    n_rows: int | None = None,
) -> DataFrame:
    """Start of every chunk: all earlier samples and pauses, plus its own chapter pause.

    Needs ``n_samples``, ``chapter_no`` and ``paragraph_break_after``.  A chunk
    opens a chapter when its chapter differs from the last known one; the
    first chapter has no pause before it.  Rows with a null key are a book of
    their own, and rows with a null place stand first.  Only narrow columns should be
    passed in; join texts back by key.

    Two things run along a book here, the known chapter and the time, and the
    second needs the first.  Both are summarised per block in one pass: inside
    a block only the pause of its first chapter is open, and that is settled
    on the block summaries.

    ``n_rows`` is the number of ``chunks``, by which they are dealt out to tasks; without it they are counted, which is
    one pass more over a table that is not stored.
    """
    n_rows = chunks.count() if n_rows is None else n_rows
    block = number_block(order[0], BLOCK_ROWS) if block is None else block
    keys, order = list(keys), list(order)
    chapter = F.col("chapter_no")
    earlier = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    chapter_gap = F.lit(silence_samples(chapter_pause)).cast("bigint")

    def gap(now: Column, known: Column) -> Column:
        return F.when(now.isNotNull() & known.isNotNull() & (now != known), chapter_gap).otherwise(
            F.lit(0).cast("bigint")
        )

    rows = (
        dealt_cells(chunks.withColumn("__cell", cell_of(keys, block)), "__cell", n_rows)
        .withColumn("__seen", F.last(chapter, ignorenulls=True).over(earlier))
        .withColumn(
            "paragraph_pause",
            F.when(F.col("paragraph_break_after"), F.lit(silence_samples(paragraph_pause)))
            .otherwise(F.lit(0))
            .cast("bigint"),
        )
    )
    sound = F.col("n_samples") + F.col("paragraph_pause")

    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    position = F.when(chapter.isNotNull(), place)
    blocks = rows.groupBy("__cell").agg(
        F.sum(sound + gap(chapter, F.col("__seen"))).alias("__span"),
        F.count(F.lit(1)).alias("__rows"),
        F.min_by(chapter, position).alias("__first"),
        F.max_by(chapter, position).alias("__last"),
    )
    blocks = blocks.select("*", *[F.col("__cell")[k].alias(k) for k in keys], F.col("__cell")[BLOCK].alias(BLOCK))
    above = number_block(BLOCK, FAN)
    known = ordered_scan(blocks, keys, [BLOCK], above, last_before={"__known": F.col("__last")}, levels=1)
    spans = known.withColumn("__span", F.col("__span") + gap(F.col("__first"), F.col("__known")))
    carries = ordered_scan(
        spans, keys, [BLOCK], above,
        sum_before={"__samples_before": F.col("__span"), "__rows_before": F.col("__rows")},
        group_sum={"total_samples": F.col("__span"), "total_chunks": F.col("__rows")},
        levels=1,
    ).select("__cell", "__known", "__samples_before", "__rows_before", "total_samples", "total_chunks")

    known = F.coalesce("__seen", "__known")
    placed = (
        rows.join(carries, "__cell")
        .withColumn("chapter_change", chapter.isNotNull() & ~chapter.eqNullSafe(known))
        .withColumn("chapter_pause", gap(chapter, known))
    )
    span = F.col("chapter_pause") + sound
    return placed.select(
        *chunks.columns,
        "chapter_change",
        "chapter_pause",
        "paragraph_pause",
        (F.coalesce(F.sum(span).over(earlier), F.lit(0)) + F.col("__samples_before")).alias("marker_sample"),
        (F.count(F.lit(1)).over(earlier) + F.col("__rows_before")).alias("chunk_no"),
        "total_samples",
        "total_chunks",
    ).withColumns(
        {
            "start_sample": F.col("marker_sample") + F.col("chapter_pause"),
            "percent": F.col("chunk_no") / F.col("total_chunks") * F.lit(100.0),
        }
    )


def chapter_markers(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None = None, n_rows: int = 0
) -> DataFrame:
    """Start and end of every chapter in samples and milliseconds.

    A marker lies before the pause of its chapter and ends where the next one
    starts, the last one at the end of the book.  ``n_rows`` is the number of
    ``lines`` that open a chapter, if known.
    """
    block = number_block(order[0], BLOCK_ROWS) if block is None else block
    opened = lines.filter("chapter_change").select(
        *keys, *order, "chapter_no", "marker_sample", "total_samples"
    )
    scanned = ordered_scan(
        opened, keys, order, block,
        following={"__next": F.col("marker_sample")}, sum_before={"marker_no": F.lit(1)}, n_rows=n_rows,
    )
    end = F.coalesce("__next", "total_samples")
    return scanned.select(
        *keys,
        (F.col("marker_no") + 1).cast("int").alias("marker_no"),
        "chapter_no",
        F.col("marker_sample").alias("start_sample"),
        end.alias("end_sample"),
        samples_millis(F.col("marker_sample")).alias("start_ms"),
        samples_millis(end).alias("end_ms"),
    )


def proportional_markers(
    chapters: DataFrame,
    totals: DataFrame,
    keys: Sequence[str],
    block_chapters: int = 65_536,
) -> DataFrame:
    """Markers placed by share of text, for books without any marker.

    ``chapters`` holds ``chapter_no`` and ``start_char``, ``totals`` one row
    per book with ``total_chars`` and ``total_samples``.  A chapter that
    starts at 0 keeps the time of the one before it; times stay within the
    book.
    """
    placed = chapters.join(totals, list(keys)).withColumn(
        "own_sample",
        F.when(
            F.col("start_char") > 0,
            F.least(
                F.floor(
                    F.col("start_char") / F.col("total_chars").cast("double") * F.col("total_samples")
                ).cast("bigint"),
                F.col("total_samples"),
            ),
        ),
    )
    scanned = ordered_scan(
        placed, keys, ["chapter_no"], number_block("chapter_no", block_chapters),
        last_before={"earlier_sample": F.col("own_sample")},
    )
    return scanned.withColumn(
        "start_sample", F.coalesce("own_sample", "earlier_sample", F.lit(0).cast("bigint"))
    ).drop("own_sample", "earlier_sample")


def marker_metadata(
    markers: DataFrame, keys: Sequence[str], block_markers: int = 4096
) -> DataFrame:
    """Chapter metadata text of every book, in blocks of ``block_markers`` chapters.

    The first block opens with the file header.  Blocks joined in ``block_no``
    order are the whole text; a book of ordinary length has one.
    """
    entry = F.concat(
        F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="),
        F.col("start_ms").cast("string"),
        F.lit("\nEND="),
        F.col("end_ms").cast("string"),
        F.lit("\ntitle="),
        F.col("title"),
        F.lit("\n"),
    )
    blocks = (
        markers.select(
            *keys,
            "marker_no",
            F.floor((F.col("marker_no") - 1) / F.lit(block_markers)).cast("bigint").alias("block_no"),
            entry.alias("entry"),
        )
        .groupBy(*keys, "block_no")
        .agg(F.array_sort(F.collect_list(F.struct("marker_no", "entry"))).alias("e"))
    )
    body = F.array_join(F.transform("e", lambda x: x["entry"]), "")
    header = F.when(F.col("block_no") == 0, F.lit(";FFMETADATA1\n")).otherwise(F.lit(""))
    return blocks.select(*keys, "block_no", F.concat(header, body).alias("metadata"))


def book_totals(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks, words and duration of every book (hash aggregate, no ordering)."""
    samples = F.sum(F.col("n_samples") + F.col("chapter_pause") + F.col("paragraph_pause"))
    return (
        lines.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_chunks"), samples.alias("total_samples"))
        .withColumn("duration", samples_clock(F.col("total_samples"), SAMPLE_RATE))
    )
