"""The whole way of books that come as many rows: chunks, chapters and time run over the rows of a book.

Every row is cut into paragraphs, sentences and packed chunks by itself.  What a row has to know of those before it is a
few numbers (characters, paragraphs, the open chunk, samples), which are carried by ordered scans over blocks of rows, so
a book of any number of rows is spread over its blocks.  The result is that of ``narrate.narration`` for the texts of the
book joined by blank lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import CHAPTER_PAUSE, PARAGRAPH_PAUSE
from ..functions.packing import paragraphs
from ..functions.text import strip
from ..operators.chapters import BLOCK_CHARS, MIN_CHAPTER_LENGTH, assign_chapters, chapter_spans, headings
from ..operators.chunks import MAX_CHARS, MIN_CHARS, PAUSE_CHARS, merged_across_rows, packed_chunks
from ..operators.scan import join_same, number_block, ordered_scan
from ..operators.timeline import timeline, with_durations
from ..session import stage


def book_rows(sections: DataFrame, keys: Sequence[str], order: str, text: str = "text", block_rows: int = 1024) -> DataFrame:
    """Rows of books that hold text, with the characters (``char_offset``) and paragraphs (``paras_before``,
    ``pos_before``) of the book before them, its characters in all (``text_chars``), and whether a row follows (``more``)."""
    keys = list(keys)
    kept = sections.filter(strip(F.col(text)) != "").select(
        *keys, F.col(order).cast("bigint").alias("no"), F.col(text).alias("text"), paragraphs(F.col(text)).alias("paras")
    )
    kept = stage(
        kept.withColumns(
            {
                "n_chars": F.length("text").cast("bigint"),
                "n_paras": F.size("paras").cast("bigint"),
                "n_pos": F.aggregate("paras", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p) + 2),
            }
        ).drop("paras"),
        "book-rows",
    )
    narrow = ordered_scan(
        kept.drop("text"), keys, ["no"], number_block("no", block_rows),
        sum_before={"char_offset": F.col("n_chars") + 2, "paras_before": F.col("n_paras"), "pos_before": F.col("n_pos")},
        following={"next_no": F.col("no")},
        group_sum={"all_chars": F.col("n_chars") + 2},
    )
    carried = narrow.select(*keys, "no", "char_offset", "paras_before", "pos_before", "next_no", "all_chars")
    return join_same(kept.select(*keys, "no", "text"), carried, [*keys, "no"]).select(
        *keys, "no", "text", "char_offset", "paras_before", "pos_before",
        (F.col("all_chars") - 2).alias("text_chars"), F.col("next_no").isNotNull().alias("more"),
    )


def narrate_books(
    sections: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str = "text",
    chapters: DataFrame | None = None,
    max_chars: int = MAX_CHARS,
    min_chars: int = MIN_CHARS,
    min_chapter_length: int = MIN_CHAPTER_LENGTH,
    paragraph_pause: float = PARAGRAPH_PAUSE,
    chapter_pause: float = CHAPTER_PAUSE,
    block_rows: int = 1024,
) -> DataFrame:
    """Chunks of books with their chapter and their place in time, one row per chunk.

    ``sections`` holds the keys of a book, ``order`` (a whole number, unique in the book) and the text of every row, as
    it is to be chunked; rows without text are left out.  ``chapters`` (keys, ``start_char``, ``end_char``,
    ``chapter_no``) are those of a table of contents; without them headings are looked for in the texts.  Null keys
    are a book of their own.  Returned are the keys, ``chunk_idx``, ``text``, ``para_idx``, ``chapter_no``,
    ``n_samples``, ``start_sample``, ``chapter_change``, ``marker_sample`` and ``total_samples``.
    """
    keys = list(keys)
    rows = stage(book_rows(sections, keys, order, text, block_rows), "book-offsets")
    if chapters is None:
        found = headings(rows.withColumnRenamed("text_chars", "book_chars"), [*keys, "char_offset", "book_chars"])
        found = found.select(*keys, (F.col("start_char") + F.col("char_offset")).alias("start_char"), "title", F.col("book_chars").alias("text_chars"))
        chapters = chapter_spans(stage(found, "book-headings"), keys, min_length=min_chapter_length)
    local = packed_chunks(F.col("text"), max_chars)
    # The last paragraph of a row is followed by a pause where another row comes behind it.
    pause = F.length(F.element_at(paragraphs(F.col("text")), -1)) >= PAUSE_CHARS
    last = lambda c, i: c["paragraph_break_after"] | ((i == F.size("local") - 1) & F.col("more") & F.col("pause"))
    whole = F.transform(
        "local",
        lambda c, i: F.struct(
            c["text"].alias("text"), c["n"].alias("n"),
            (c["para_idx"] + F.col("paras_before")).cast("int").alias("para_idx"),
            (c["para_pos"] + F.col("pos_before")).alias("para_pos"),
            last(c, i).alias("paragraph_break_after"),
        ),
    )
    packed = stage(rows.select(*keys, "no", "more", "paras_before", "pos_before", pause.alias("pause"), local.alias("local")), "book-packed")
    packed = packed.select(*keys, "no", whole.alias("chunks"))
    merged = stage(merged_across_rows(packed, keys, "no", min_chars, max_chars, block_rows), "book-chunks")
    n_chunks = merged.count()
    placed = assign_chapters(
        with_durations(merged).select(*keys, "chunk_no", "para_pos", "paragraph_break_after", "n_samples"),
        chapters.select(*keys, "start_char", "chapter_no", F.lit(None).cast("bigint").alias("end_char")), keys, "para_pos", BLOCK_CHARS, n_chunks,
    )
    timed = timeline(
        placed.withColumnRenamed("chunk_no", "place"), keys, ["place"], number_block("place", 65_536), paragraph_pause, chapter_pause,
        n_rows=n_chunks,
    ).select(*keys, F.col("place").alias("chunk_no"), "chapter_no", "n_samples", "start_sample", "chapter_change", "marker_sample", "total_samples")
    return join_same(merged.select(*keys, "chunk_no", "text", "para_idx"), timed, [*keys, "chunk_no"]).select(
        *keys, F.col("chunk_no").cast("int").alias("chunk_idx"), "text", "para_idx",
        "chapter_no", "n_samples", "start_sample", "chapter_change", "marker_sample", "total_samples",
    )
