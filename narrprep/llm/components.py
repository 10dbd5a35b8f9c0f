"""Connected components of a table of links, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _both_ways(links: DataFrame) -> DataFrame:
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return links.select(F.inline(F.array(there, back)))


def _with_least(links: DataFrame, hub: int | None) -> DataFrame:
    """Links and ``m``, the least neighbour ``v`` of their ``u``; those of a hub are not gathered in one task.

    A hub has more than ``hub`` links; None says that there is none.
    """
    if hub is None:
        return links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    hubs = links.groupBy("u").agg(F.min("v").alias("of_hub"), F.count(F.lit(1)).alias("links")).filter(F.col("links") > hub)
    told = links.join(F.broadcast(hubs.drop("links")), "u", "left")
    # Links of a hub know their least neighbour, so they may be dealt out by the other end.
    known = F.col("of_hub").isNotNull()
    place = F.when(known, F.xxhash64("v")).otherwise(F.col("u"))
    told = told.withColumns({"known": known, "place": place})
    least = F.min("v").over(Window.partitionBy("place", "known"))
    return told.select("u", "v", F.coalesce("of_hub", least).alias("m"))


def _large_star(links: DataFrame, hub: int | None) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = _with_least(_both_ways(links), hub)
    return both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame, hub: int | None) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    moved = _with_least(links, hub)
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(links: DataFrame) -> tuple[int, int, int | None]:
    """Number and sum of the links, by which a change is seen, and from how many links on a node is a hub, if there is one."""
    both = _both_ways(links).groupBy("u").agg(
        F.count(F.lit(1)).alias("held"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
    )
    n, total, most = both.agg(F.sum("held"), F.sum("total"), F.max("held")).first()
    hub = max((n or 0) // 2000, 1000)
    return n or 0, total, hub if (most or 0) > hub else None


def components(links: DataFrame, label: str) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of the links ``u``, ``v``.

    Large-star and small-star steps take turns until nothing changes; their number grows with the logarithm of the
    longest path.  Links of a hub (more than a thousandth of all links, so that there are few) are grouped with
    map-side combine, and its least neighbour is broadcast to them.  A step makes few jobs, since the driver plans
    and keeps each of them.  Links from a node to itself and null ends are left out; repeated links count once.
    """
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = stage(now, f"{label}-links")
    before = None
    while True:
        n, total, hub = _state(now)
        if (n, total) == before or not n:
            break
        before = n, total
        # No node gains links in the large-star step, so there is no new hub after it.
        large = stage(_large_star(now, hub), f"{label}-large")
        now = stage(_small_star(large, hub), f"{label}-small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
