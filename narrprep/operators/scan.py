"""Ordered scans that split long groups.

``sum(...) over (partition by book order by pos)`` puts a whole book in one
task, and a hot book may hold a third of all rows.  Here a group is cut into
blocks by its order column.  Every block is summarised (map-side combined),
the block summaries are scanned per group, and rows are scanned inside their
block only, starting from what the block carries in.  The summaries are scanned
the same way, in blocks of ``FAN`` blocks, so that a task holds one block of
rows, one block of summaries, or the few summaries of the last level.

The block is a function of the row's own order value, so all passes and any
recomputed task agree on it.  A block and its keys form one struct, which
compares nulls as equal: rows with a null key are a group like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
#: Block numbers in one block of the next level.
FAN = 1024
#: Rows that one task sorts, on average.
TASK_ROWS = 500_000


def number_block(order: Column | str, rows: int) -> Column:
    """Block of an integer order column: ``rows`` consecutive values."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(rows)).cast("bigint")


def time_block(ts: Column | str, seconds: int = 300) -> Column:
    """Block of a time column: a fixed span of seconds, chosen so that a busy job fits one task."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(seconds)).cast("bigint")


def cell_of(keys: Sequence[str], block: Column) -> Column:
    """A block of a group as one value; null keys and blocks equal each other."""
    return F.struct(block.alias(BLOCK), *[F.col(k) for k in keys])


def dealt_cells(df: DataFrame, cell: str, rows: int) -> DataFrame:
    """``df`` with every cell in one partition, about ``TASK_ROWS`` of the ``rows`` in each.

    Adaptive execution merges partitions by their compressed bytes, and narrow rows of a book take few of them, so that
    a task would sort more rows the larger the table is.  It leaves a number of partitions that is asked for.
    """
    if rows <= TASK_ROWS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), cell)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    sum_before: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    group_sum: Mapping[str, Column] | None = None,
    levels: int = 2,
    fan: int = FAN,
    n_rows: int = 0,
) -> DataFrame:
    """Add ordered columns per group of ``keys``, ordered by ``order`` (unique, not null).

    ``sum_before``   sum over the earlier rows (0 for the first row)
    ``last_before``  last value that is not null among the earlier rows
    ``previous``     value of the row before, null for the first row
    ``following``    value of the row after, null for the last row
    ``group_sum``    sum over the whole group

    ``block`` must not decrease along ``order``.  Keys may be null.  ``levels``
    counts the levels of blocks; above the last one the summaries of a group
    are scanned in one task.  ``n_rows`` is the number of rows, if known, by
    which they are dealt out (``dealt_cells``).
    """
    kinds = {
        "sum": dict(sum_before or {}),
        "last": dict(last_before or {}),
        "prev": dict(previous or {}),
        "next": dict(following or {}),
        "total": dict(group_sum or {}),
    }
    keys, order = list(keys), list(order)
    cell, number = f"__cell{levels}", f"__block{levels}"
    rows = dealt_cells(df.withColumn(cell, cell_of(keys, block)), cell, n_rows)
    for kind, columns in kinds.items():
        for name, value in columns.items():
            rows = rows.withColumn(f"__{kind}_{name}", value)

    # One order column is compared as it is; a struct only where there are more.
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    partial = []
    for name in kinds["sum"]:
        partial.append(F.sum(f"__sum_{name}").alias(f"__b_sum_{name}"))
    for name in kinds["total"]:
        partial.append(F.sum(f"__total_{name}").alias(f"__b_total_{name}"))
    for name in kinds["last"]:
        v = F.col(f"__last_{name}")
        partial.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"__b_last_{name}"))
    for name in kinds["prev"]:
        v = F.struct(F.col(f"__prev_{name}").alias("v"))
        partial.append(F.max_by(v, position).alias(f"__b_prev_{name}"))
    for name in kinds["next"]:
        v = F.struct(F.col(f"__next_{name}").alias("v"))
        partial.append(F.min_by(v, position).alias(f"__b_next_{name}"))
    blocks = rows.groupBy(cell).agg(*partial) if partial else rows.select(cell).distinct()
    blocks = blocks.select("*", *[F.col(cell)[k].alias(k) for k in keys], F.col(cell)[BLOCK].alias(number))
    carry = _carries(blocks, kinds, keys, number, levels, fan)
    # A group of one block carries nothing in, so only longer groups are joined.
    carries = carry.filter("__n_blocks > 1").select(cell, *[c for c in carry.columns if c.startswith("__c_")])

    joined = rows.join(carries, cell, "left")
    inside = Window.partitionBy(cell)
    ordered = inside.orderBy(*order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for name in kinds["sum"]:
        local = F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0))
        out.append((local + F.coalesce(F.col(f"__c_sum_{name}"), F.lit(0))).alias(name))
    for name in kinds["total"]:
        local = F.sum(f"__total_{name}").over(inside)
        out.append(F.coalesce(F.col(f"__c_total_{name}"), local).alias(name))
    for name in kinds["last"]:
        local = F.last(f"__last_{name}", ignorenulls=True).over(earlier)
        out.append(F.coalesce(local, F.col(f"__c_last_{name}")).alias(name))
    for name in kinds["prev"]:
        local = F.lag(F.struct(F.col(f"__prev_{name}").alias("v"))).over(ordered)
        out.append(F.coalesce(local, F.col(f"__c_prev_{name}"))["v"].alias(name))
    for name in kinds["next"]:
        local = F.lead(F.struct(F.col(f"__next_{name}").alias("v"))).over(ordered)
        out.append(F.coalesce(local, F.col(f"__c_next_{name}"))["v"].alias(name))
    return joined.select(*df.columns, *out)


def _carries(blocks: DataFrame, kinds: dict, keys: list[str], number: str, levels: int, fan: int) -> DataFrame:
    """What every block carries in (``__c_…``) and the number of blocks of its group."""
    if levels > 1:
        return ordered_scan(
            blocks, keys, [number], number_block(number, fan),
            sum_before={f"__c_sum_{n}": F.col(f"__b_sum_{n}") for n in kinds["sum"]},
            last_before={f"__c_last_{n}": F.col(f"__b_last_{n}") for n in kinds["last"]},
            previous={f"__c_prev_{n}": F.col(f"__b_prev_{n}") for n in kinds["prev"]},
            following={f"__c_next_{n}": F.col(f"__b_next_{n}") for n in kinds["next"]},
            group_sum={f"__c_total_{n}": F.col(f"__b_total_{n}") for n in kinds["total"]} | {"__n_blocks": F.lit(1)},
            levels=levels - 1, fan=fan,
        )
    whole = Window.partitionBy(*keys)
    along = whole.orderBy(number)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.count(F.lit(1)).over(whole).alias("__n_blocks")]
    for name in kinds["sum"]:
        carry.append(F.sum(f"__b_sum_{name}").over(before).alias(f"__c_sum_{name}"))
    for name in kinds["total"]:
        carry.append(F.sum(f"__b_total_{name}").over(whole).alias(f"__c_total_{name}"))
    for name in kinds["last"]:
        carry.append(F.last(f"__b_last_{name}", ignorenulls=True).over(before).alias(f"__c_last_{name}"))
    for name in kinds["prev"]:
        carry.append(F.lag(f"__b_prev_{name}").over(along).alias(f"__c_prev_{name}"))
    for name in kinds["next"]:
        carry.append(F.lead(f"__b_next_{name}").over(along).alias(f"__c_next_{name}"))
    return blocks.select("*", *carry)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    values: Sequence[str],
    block_size: int,
    n_rows: int = 0,
) -> DataFrame:
    """For every left row the right row with the greatest position <= its own.

    Both sides become one table ordered by position, right rows first, and the
    last right row is carried forward: no range join, no pairs within a group.
    Of right rows at one position the one that sorts last by ``values`` wins.
    ``n_rows`` is the number of left rows, if known (``ordered_scan``).
    """
    payload = F.struct(*[F.col(v) for v in values])
    side = [*keys, "__pos", "__side", "__tie", "__hit"]
    right_rows = right.select(
        *keys,
        F.col(right_pos).cast("bigint").alias("__pos"),
        F.lit(0).alias("__side"),
        payload.alias("__hit"),
    ).withColumn("__tie", F.xxhash64("__hit"))
    left_rows = left.withColumns(
        {
            "__pos": F.col(left_pos).cast("bigint"),
            "__side": F.lit(1),
            "__tie": F.xxhash64(*[F.col(c) for c in left.columns]),
        }
    )
    both = left_rows.unionByName(right_rows.select(*side), allowMissingColumns=True)
    order = ["__pos", "__side", "__hit", "__tie"]
    scanned = ordered_scan(
        both, keys, order, number_block("__pos", block_size), last_before={"__found": F.col("__hit")},
        n_rows=n_rows,
    )
    return scanned.filter("__side = 1").select(
        *left.columns, *[F.col("__found")[v].alias(v) for v in values]
    )


def effect_of(steps: Column, step, states: int) -> Column:
    """What a run of steps does to every state 0 to ``states`` - 1, as an array; ``step(state, item)`` does one."""
    return F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate(steps, s, step))


def states_before(
    runs: DataFrame, start: DataFrame | None, states: int, default: int = 0, levels: int = 1, fan: int = FAN
) -> DataFrame:
    """``key``, ``no`` and the ``state`` in which every run of steps finds its group.

    ``runs`` holds ``key`` (a struct, never null itself), ``no`` (its place in the group, unique) and ``effect``
    (``effect_of``).  A step maps states to states, and so does a run of steps, so runs are composed like steps: in
    blocks of ``fan`` numbers, ``levels`` times over, and no task holds more than a block of maps.  ``start`` holds
    ``key`` and ``state`` of the groups that do not begin in state ``default``.
    """
    through = lambda s, run: F.get(run["effect"], s)
    listed = F.array_sort(F.collect_list(F.struct("no", "effect"))).alias("runs")
    if levels == 0:
        gathered = runs.groupBy("key").agg(listed)
        if start is None:
            gathered = gathered.withColumn("state", F.lit(default))
        else:
            gathered = gathered.join(start.select("key", "state"), "key", "left")
            gathered = gathered.withColumn("state", F.coalesce("state", F.lit(default)))
    else:
        gathered = runs.groupBy("key", number_block("no", fan).alias("upper")).agg(listed)
        above = gathered.select("key", F.col("upper").alias("no"), effect_of(F.col("runs"), through, states).alias("effect"))
        found = states_before(above, start, states, default, levels - 1, fan).withColumnRenamed("no", "upper")
        gathered = gathered.join(found, ["key", "upper"])
    zero = F.struct(F.col("state").cast("int").alias("state"), F.array().cast("array<struct<no:bigint,state:int>>").alias("found"))

    def step(acc: Column, run: Column) -> Column:
        here = F.struct(run["no"].cast("bigint").alias("no"), acc["state"].alias("state"))
        return F.struct(through(acc["state"], run).cast("int").alias("state"), F.concat(acc["found"], F.array(here)).alias("found"))

    return gathered.select("key", F.inline(F.aggregate("runs", zero, step, lambda acc: acc["found"])))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null, which equal each other; the keys come once."""
    renamed = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, match)).drop(*[f"__same_{k}" for k in keys])
