"""Ordered sections of a book: offsets and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import number_block, ordered_scan

BLOCK_ROWS = 1024


def section_offsets(
    sections: DataFrame,
    keys: Sequence[str],
    order: str,
    length: Column,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Character offset of every section in the assembled book.

    Sections are joined by a blank line and empty ones are left out first, so
    an offset points exactly at its section.  Only keys and lengths are
    shuffled, never the text.
    """
    narrow = sections.select(*keys, order, length.cast("bigint").alias("n_chars")).filter("n_chars > 0")
    return ordered_scan(
        narrow,
        keys,
        [order],
        number_block(order, block_rows),
        sum_before={"char_offset": F.col("n_chars") + F.lit(2)},
    )


def assemble(
    sections: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    block_rows: int = BLOCK_ROWS,
    first: int = 0,
) -> DataFrame:
    """Book text as ordered blocks: sections joined by a blank line.

    A block holds the sections of ``block_rows`` consecutive order values, the
    first block those from ``first`` on, so no task builds more than that.  A
    book whose numbers all lie in one block is one row; the blocks of another,
    joined by a blank line in ``block_no`` order, are its whole text.
    """
    blocks = (
        sections.filter(F.length(text) > 0)
        .withColumn("block_no", number_block(F.col(order) - first, block_rows))
        .groupBy(*keys, "block_no")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts")
        )
        .select(
            *keys,
            "block_no",
            F.size("parts").cast("bigint").alias("n_sections"),
            F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"),
        )
    )
    return blocks


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + n`` of every group.

    The rank filter lets Spark drop the rest of a group before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("row_no", F.row_number().over(w))
        .filter(F.col("row_no") <= skip + n)
        .filter(F.col("row_no") > skip)
    )
