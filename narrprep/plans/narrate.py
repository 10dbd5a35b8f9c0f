"""The whole way of a document: clean, find chapters, chunk, place in time.

A document is one row, and every step works inside the row, so the plan is a
scan, a projection and a write: no shuffle at any corpus size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_column, last_start_at, let, running_offsets
from ..functions.numbers import (
    CHAPTER_PAUSE,
    PARAGRAPH_PAUSE,
    samples_clock,
    samples_millis,
    silence_samples,
    spoken_samples,
)
from ..functions.text import word_count
from ..operators.chapters import MIN_CHAPTER_LENGTH, chapter_array
from ..operators.chunks import MAX_CHARS, MIN_CHARS, merged_chunks, packed_chunks
from ..operators.clean import clean_documents


def narration(
    text: Column,
    raw: Column | None = None,
    max_chars: int = MAX_CHARS,
    min_chars: int = MIN_CHARS,
    min_chapter_length: int = MIN_CHAPTER_LENGTH,
    speed: float = 1.0,
    paragraph_pause: float = PARAGRAPH_PAUSE,
    chapter_pause: float = CHAPTER_PAUSE,
) -> Column:
    """Struct(chapters, chunks) of one text, chunks with their place in time.

    Chapters are found in the text that is chunked.  With ``raw`` they are
    found there instead, and their offsets then drift against the chunks.
    """
    after_paragraph = silence_samples(paragraph_pause)
    before_chapter = silence_samples(chapter_pause)

    def placed(chunks: Column, numbers: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            number = numbers[i]
            previous = F.when(i > 0, F.get(numbers, i - 1)).otherwise(F.lit(0))
            change = (number > 0) & (number != previous)
            return F.struct(
                c["text"].alias("text"),
                c["para_idx"].alias("para_idx"),
                F.nullif(number, F.lit(0)).cast("int").alias("chapter_no"),
                change.alias("chapter_change"),
                let(word_count(c["text"]), lambda n: spoken_samples(n, speed)).alias("n_samples"),
                F.when(change & (previous > 0), F.lit(before_chapter)).otherwise(F.lit(0)).alias("before"),
                F.when(c["paragraph_break_after"], F.lit(after_paragraph)).otherwise(F.lit(0)).alias("after"),
            )

        return F.transform(chunks, one)

    def timed(rows: Column) -> Column:
        spans = F.transform(rows, lambda r: r["before"] + r["n_samples"] + r["after"])
        return let(
            running_offsets(spans, 0),
            lambda starts: F.transform(
                rows,
                lambda r, i: F.struct(
                    r["text"].alias("text"),
                    r["para_idx"].alias("para_idx"),
                    r["chapter_no"].alias("chapter_no"),
                    r["chapter_change"].alias("chapter_change"),
                    r["n_samples"].alias("n_samples"),
                    starts[i].alias("marker_sample"),
                    (starts[i] + r["before"]).alias("start_sample"),
                    (starts[i] + r["before"] + r["n_samples"] + r["after"]).alias("end_sample"),
                ),
            ),
        )

    def of_text(t: Column) -> Column:
        found = chapter_array(t if raw is None else raw, min_chapter_length)
        slim = F.transform(
            found,
            lambda c: F.struct(
                c["title"].alias("title"), c["number"].alias("number"),
                c["start_char"].alias("start_char"), c["end_char"].alias("end_char"),
            ),
        )
        chunks = merged_chunks(packed_chunks(t, max_chars), min_chars, max_chars)
        return let(
            F.struct(slim.alias("ch"), chunks.alias("ck")),
            lambda x: let(
                last_start_at(
                    F.transform(x["ck"], lambda c: c["para_pos"]), F.transform(x["ch"], lambda c: c["start_char"])
                ),
                lambda numbers: let(
                    placed(x["ck"], numbers), lambda rows: F.struct(x["ch"].alias("chapters"), timed(rows).alias("chunks"))
                ),
            ),
        )

    return let(text, of_text)


def narrate(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    rules=None,
    drift: bool = False,
    **settings,
) -> DataFrame:
    """Keys, detected language and ``narration`` of every document."""
    cleaned = clean_documents(docs, text, "__clean", rules=rules)
    raw = F.col(text) if drift else None
    return cleaned.select(*keys, "detected", narration(F.col("__clean"), raw, **settings).alias("narration"))


def narration_chunks(narrated: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    fields = ["text", "para_idx", "chapter_no", "n_samples", "start_sample"]
    return explode_column(narrated, keys, "narration.chunks", "chunk_idx", "c").select(
        *keys, "chunk_idx", *[F.col(f"c.{f}") for f in fields]
    )


def narration_markers(narrated: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Chapter markers in the row: each ends where the next one starts."""

    def marks(n: Column) -> Column:
        opened = F.filter(n["chunks"], lambda c: c["chapter_change"])
        total = F.element_at(n["chunks"], -1)["end_sample"]

        def one(opening: Column, m: Column, i: Column) -> Column:
            end = F.coalesce(F.get(opening, i + 1)["marker_sample"], total)
            return F.struct(
                F.get(n["chapters"], m["chapter_no"] - 1)["title"].alias("title"),
                m["chapter_no"].alias("chapter_no"),
                samples_millis(m["marker_sample"]).alias("start_ms"),
                samples_millis(end).alias("end_ms"),
            )

        return let(opened, lambda o: F.transform(o, lambda m, i: one(o, m, i)))

    return explode_column(narrated, keys, let(F.col("narration"), marks), "i", "m").select(
        *keys, (F.col("i") + 1).cast("int").alias("marker_no"), "m.chapter_no", "m.title", "m.start_ms", "m.end_ms"
    )


def narration_summary(narrated: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    total = F.coalesce(F.try_element_at("narration.chunks", F.lit(-1))["end_sample"], F.lit(0).cast("bigint"))
    return narrated.select(
        *keys,
        "detected",
        F.size("narration.chapters").alias("n_chapters"),
        F.size("narration.chunks").alias("n_chunks"),
        total.alias("total_samples"),
    ).withColumn("duration", samples_clock(F.col("total_samples")))
