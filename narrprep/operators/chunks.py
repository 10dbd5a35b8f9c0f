"""Chunks: paragraphs -> sentences -> size-bounded pieces, all inside the row.

Intermediate arrays are bound with ``let`` and not as columns: the optimizer
puts a column that is named once into the lambda that names it, which would
compute it anew for every element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import TAIL, explode_column, let, running_offsets, slices
from ..functions.packing import merge_starts, pack_starts, paragraphs, sentence_pieces, sentences
from ..session import stage
from .scan import effect_of, join_same, number_block, ordered_scan, states_before

MAX_CHARS = 400
MIN_CHARS = 50
PAUSE_CHARS = 100


def sentence_rows(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per sentence with its paragraph and place."""
    return (
        df.select(*keys, F.posexplode(paragraphs(F.col(text))).alias("para_idx", "__p"))
        .select(*keys, "para_idx", F.posexplode(sentences(F.col("__p"))).alias("sent_idx", "sentence"))
    )


def packed_chunks(
    text: Column, max_chars: int = MAX_CHARS, pause_chars: int = PAUSE_CHARS, compat: bool = False
) -> Column:
    """Array of (text, n, para_idx, para_pos, paragraph_break_after) of one text."""

    def of_paragraph(paras: Column, starts: Column, p: Column, i: Column) -> Column:
        breaks = (i < F.size(paras) - 1) & (F.length(p) >= pause_chars)
        texts = let(
            sentence_pieces(p, max_chars, compat),
            lambda pieces: let(
                pack_starts(pieces, max_chars),
                lambda opened: F.transform(
                    slices(pieces, opened), lambda g: F.array_join(F.transform(g, lambda x: x["t"]), " ")
                ),
            ),
        )
        return let(
            texts,
            lambda group: F.transform(
                group,
                lambda t, k: F.struct(
                    t.alias("text"),
                    F.length(t).alias("n"),
                    i.cast("int").alias("para_idx"),
                    starts[i].alias("para_pos"),
                    (breaks & (k == F.size(group) - 1)).alias("paragraph_break_after"),
                ),
            ),
        )

    return let(
        paragraphs(text),
        lambda paras: let(
            running_offsets(F.transform(paras, F.length), 2),
            lambda starts: F.flatten(
                F.transform(paras, lambda p, i: of_paragraph(paras, starts, p, i))
            ),
        ),
    )


def merged_chunks(packed: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Merge short chunks forward; a merged chunk takes place and pause of its last part."""

    def merged(group: Column) -> Column:
        last = F.element_at(group, -1)
        text = F.array_join(F.transform(group, lambda c: c["text"]), " ")
        return F.struct(
            text.alias("text"),
            F.length(text).alias("n"),
            last["para_idx"].alias("para_idx"),
            last["para_pos"].alias("para_pos"),
            last["paragraph_break_after"].alias("paragraph_break_after"),
        )

    return let(
        packed,
        lambda chunks: let(
            merge_starts(chunks, min_chars, max_chars),
            lambda opened: F.transform(slices(chunks, opened), merged),
        ),
    )


def _opened(state: Column, n: Column, min_chars: int, max_chars: int) -> tuple[Column, Column]:
    """Whether a chunk of ``n`` characters opens a merged one, and the length of the open chunk behind it.

    ``state`` is the length of an open chunk that is still short, 0 where there is none.
    """
    joins = (state > 0) & (state + 1 + n <= max_chars)
    length = F.when(joins, state + 1 + n).otherwise(n)
    return ~joins, F.when(length < min_chars, length).otherwise(0).cast("int")


def merged_across_rows(
    packed: DataFrame,
    keys: Sequence[str],
    order: str,
    min_chars: int = MIN_CHARS,
    max_chars: int = MAX_CHARS,
    block_rows: int = 1024,
) -> DataFrame:
    """Merged chunks of books that come as many rows: short chunks merge forward, also into the next row.

    ``packed`` holds the keys of a book, ``order`` (a whole number per row, unique in the book) and ``chunks``, the
    packed chunks of the row (``packed_chunks``, fields ``text``, ``n``, ``para_idx``, ``para_pos`` and
    ``paragraph_break_after``, counted over the whole book).  Returns keys, ``chunk_no`` (from 0 in the book) and the
    fields of a chunk, as ``merged_chunks`` gives them for the book in one row.

    Whether a chunk opens a merged one depends on the open chunk before it only, whose length matters while it is below
    ``min_chars``.  So a row maps ``min_chars`` states to states, and the maps are composed (``scan.states_before``).
    Only the chunks at both ends of a row are shuffled to be joined.
    """
    keys = list(keys)
    after = lambda s, c: _opened(s, c["n"].cast("int"), min_chars, max_chars)[1]
    rows = packed.withColumns({"key": F.struct(*keys), "no": F.col(order).cast("bigint")})
    runs = rows.select("key", "no", effect_of(F.col("chunks"), after, min_chars).alias("effect"))
    rows = rows.join(states_before(runs, None, min_chars, fan=block_rows), ["key", "no"])
    # Lengths go through one fold that tells which chunks open; texts are sliced by it afterwards.
    done, tail = F.array().cast("array<array<boolean>>"), F.array().cast("array<boolean>")

    def step(acc: Column, c: Column) -> Column:
        opens, state = _opened(acc["state"], c["n"].cast("int"), min_chars, max_chars)
        full = F.size(acc["tail"]) >= TAIL
        return F.struct(
            state.alias("state"),
            F.when(full, F.concat(acc["done"], F.array(acc["tail"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(opens)).otherwise(F.concat(acc["tail"], F.array(opens))).alias("tail"),
        )

    zero = F.struct(F.col("state").cast("int").alias("state"), done.alias("done"), tail.alias("tail"))
    opens = F.aggregate("chunks", zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["tail"]))))
    # The first chunk of a row opens a group of the row in any case; ``joins`` says that it belongs to the row before.
    starts = lambda o: F.filter(F.transform(o, lambda x, i: F.when(x | (i == 0), (i + 1).cast("bigint"))), lambda x: x.isNotNull())
    group = lambda g: F.struct(
        F.array_join(F.transform(g, lambda c: c["text"]), " ").alias("text"),
        F.element_at(g, -1)["para_idx"].alias("para_idx"),
        F.element_at(g, -1)["para_pos"].alias("para_pos"),
        F.element_at(g, -1)["paragraph_break_after"].alias("paragraph_break_after"),
    )
    told = rows.filter(F.size("chunks") > 0).select(
        *keys, "no",
        let(opens, lambda o: F.struct(
            (~o[0]).alias("joins"),
            F.transform(slices(F.col("chunks"), starts(o)), group).alias("groups"),
        )).alias("t"),
    ).select(*keys, "no", "t.joins", "t.groups")
    told = stage(told, "chunks-by-row")
    opened = (F.size("groups") - F.col("joins").cast("int")).cast("bigint")
    counted = ordered_scan(
        told.select(*keys, "no", opened.alias("opened")), keys, ["no"], number_block("no", block_rows),
        sum_before={"first": F.col("opened")},
    )
    numbered = join_same(told, counted.select(*keys, "no", "first"), [*keys, "no"]).withColumn(
        "first", F.col("first") - F.col("joins").cast("int")
    )
    each = explode_column(numbered.withColumn("size", F.size("groups")), [*keys, "no", "size", "first"], "groups", "i", "g").select(
        *keys, (F.col("first") + F.col("i")).alias("chunk_no"), "no", ((F.col("i") == 0) | (F.col("i") == F.col("size") - 1)).alias("end"), "g"
    )
    ends = each.filter("end").groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list(F.struct("no", "g"))).alias("all"))
    last = F.element_at(F.col("all"), -1)["g"]
    joined = ends.select(
        *keys, "chunk_no", F.array_join(F.transform("all", lambda x: x["g"]["text"]), " ").alias("text"),
        last["para_idx"].alias("para_idx"), last["para_pos"].alias("para_pos"), last["paragraph_break_after"].alias("paragraph_break_after"),
    )
    return each.filter("not end").select(*keys, "chunk_no", "g.*").unionByName(joined)


def chunk_rows(df: DataFrame, keys: Sequence[str], chunks: Column) -> DataFrame:
    fields = ["text", "para_idx", "para_pos", "paragraph_break_after"]
    return df.select(*keys, F.posexplode(chunks).alias("chunk_idx", "__c")).select(
        *keys, "chunk_idx", *[F.col(f"__c.{f}") for f in fields]
    )


def chunk_documents(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    max_chars: int = MAX_CHARS,
    min_chars: int = MIN_CHARS,
    pause_chars: int = PAUSE_CHARS,
    compat: bool = False,
) -> DataFrame:
    """Size-bounded chunks of texts that are one row each, without a shuffle.

    Pass chapter rows (``document_chapters``) with the chapter among the keys
    to keep chunks from crossing chapters.
    """
    packed = packed_chunks(F.col(text), max_chars, pause_chars, compat)
    return chunk_rows(df, keys, merged_chunks(packed, min_chars, max_chars))
