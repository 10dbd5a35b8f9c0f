"""Linear in-row folds over arrays.

A document is one row, so anything that is sequential inside a document
(running offsets, greedy packing) is a fold over an array of lengths in that
row: no shuffle, no grouping, and rows stay independent.  ``aggregate`` copies
its whole state at every step, arrays element by element, so the numbers a
fold puts out are noted in one string, whose copy is a block of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAIL = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def explode_column(df: DataFrame, keep: Sequence[str], array: Column | str, pos: str, item: str) -> DataFrame:
    """``posexplode`` of an array column that was expensive to make.

    For a plain ``posexplode`` of a column the optimizer adds the filter
    ``size(column) > 0`` and moves it down with the whole expression behind
    the column, which is then computed twice, and below a repartition.  The
    outer form gets no such filter.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def _note(out: Column, number: Column) -> Column:
    return F.concat(out, F.lit(","), number.cast("string"))


def _noted(acc: Column) -> Column:
    numbers = F.split(F.substr(acc["out"], F.lit(2)), ",").cast("array<bigint>")
    return F.when(acc["out"] == "", F.array().cast("array<bigint>")).otherwise(numbers)


def running_offsets(lengths: Column, gap: int, first: Column | int = 0) -> Column:
    """Start offset of every element when elements are joined by ``gap`` characters."""
    start = first if isinstance(first, Column) else F.lit(first)

    def step(acc: Column, n: Column) -> Column:
        return F.struct(
            (acc["pos"] + n.cast("bigint") + F.lit(gap).cast("bigint")).alias("pos"),
            _note(acc["out"], acc["pos"]).alias("out"),
        )

    zero = F.struct(start.cast("bigint").alias("pos"), F.lit("").alias("out"))
    return F.aggregate(lengths, zero, step, _noted)


def group_starts(
    items: Column,
    opens: Callable[[Column, Column], Column],
    gap: int,
    solo: Callable[[Column], Column] | None = None,
    first_extra: int = 0,
) -> Column:
    """Greedy grouping: 1-based positions of the items that open a group.

    ``items`` is an array of structs with a field ``n`` (length).  ``opens(cur,
    item)`` says whether the item opens a new group when the open group holds
    ``cur`` characters.  An item for which ``solo`` holds always stands alone.
    """
    is_solo = solo or (lambda item: F.lit(False))

    def step(acc: Column, item: Column) -> Column:
        n = item["n"].cast("bigint")
        opened = (~acc["open"]) | is_solo(item) | opens(acc["cur"], item)
        first = F.when(acc["pos"] == 1, F.lit(first_extra)).otherwise(F.lit(0)).cast("bigint")
        return F.struct(
            (acc["pos"] + F.lit(1)).cast("bigint").alias("pos"),
            F.when(opened, n + first).otherwise(acc["cur"] + n + F.lit(gap)).cast("bigint").alias("cur"),
            (~is_solo(item)).alias("open"),
            F.when(opened, _note(acc["out"], acc["pos"])).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(
        F.lit(1).cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("cur"),
        F.lit(False).alias("open"),
        F.lit("").alias("out"),
    )
    return F.aggregate(items, zero, step, _noted)


def slices(items: Column, starts: Column) -> Column:
    """Cut ``items`` at the 1-based ``starts``; every slice is a sub-array."""
    total = F.size(items)
    return F.transform(
        starts,
        lambda s, i: F.slice(
            items,
            s.cast("int"),
            (F.coalesce(F.try_element_at(starts, i + F.lit(2)), total + F.lit(1)) - s).cast("int"),
        ),
    )


def last_start_at(positions: Column, starts: Column) -> Column:
    """For every position the 1-based number of the last start at or before it, 0 for none.

    Both arrays rise; they are merged and scanned once, so nothing is
    compared pairwise.
    """
    marks = F.concat(
        F.transform(
            starts,
            lambda s, i: F.struct(
                s.cast("bigint").alias("at"), F.lit(0).alias("side"), (i + F.lit(1)).cast("bigint").alias("no")
            ),
        ),
        F.transform(
            positions,
            lambda p, i: F.struct(p.cast("bigint").alias("at"), F.lit(1).alias("side"), i.cast("bigint").alias("no")),
        ),
    )

    def step(acc: Column, mark: Column) -> Column:
        is_start = mark["side"] == 0
        return F.struct(
            F.when(is_start, mark["no"]).otherwise(acc["cur"]).alias("cur"),
            F.when(is_start, acc["out"]).otherwise(_note(acc["out"], acc["cur"])).alias("out"),
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("cur"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(marks), zero, step, _noted)
