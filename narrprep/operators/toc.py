"""Tables of contents: validation, flattening and section lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, strip, without_fragment
from ..session import stage


def valid_entries(toc: DataFrame) -> DataFrame:
    """Entries that have a title and point to a section."""
    return toc.withColumn("title", strip(F.col("title"))).filter(
        (F.col("section_num") > 0) & (F.col("title") != "")
    )


def _rank(order: Column) -> Column:
    """Text that sorts like the number: twelve digits, longer numbers behind and negative ones before them."""
    wide = lambda n: F.lpad(n.cast("string"), 19, "0")
    return (
        F.when(order < 0, F.concat(F.lit("-"), wide(order + F.lit(2**63 - 1))))
        .when(order >= 10**12, F.concat(F.lit("~"), wide(order)))
        .otherwise(F.lpad(order.cast("string"), 12, "0"))
    )


def flatten_toc(entries: DataFrame, keys: Sequence[str], max_levels: int | None = None) -> DataFrame:
    """Depth-first level and path of a tree given as (entry_id, parent_id, ord).

    One join per level; the loop ends at the first level without entries.
    Every level is written to the shared folder, so a level is joined once and
    a lost executor costs a read.  ``path`` sorts entries of a book in
    depth-first order.
    """
    keys = list(keys)
    rank = _rank(F.col("ord").cast("bigint"))
    frontier = entries.filter(F.col("parent_id").isNull()).withColumns(
        {"level": F.lit(1), "path": rank}
    )
    levels = [frontier]
    while max_levels is None or len(levels) < max_levels:
        parents = frontier.select(
            *keys,
            F.col("entry_id").alias("parent_id"),
            (F.col("level") + 1).alias("level"),
            F.col("path").alias("__up"),
        )
        children = (
            entries.join(parents, [*keys, "parent_id"])
            .withColumn("path", F.concat_ws(".", "__up", rank))
            .drop("__up")
        )
        frontier = stage(children, "toc-level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    flat = levels[0]
    for level in levels[1:]:
        flat = flat.unionByName(level)
    return flat


def section_names(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names a section can be linked by: its address and its base name.

    A name used twice belongs to the later section.
    """
    return (
        sections.select(
            *keys,
            "section_num",
            F.explode(F.array_distinct(F.array("href", base_name(F.col("href"))))).alias("name"),
        )
        .groupBy(*keys, "name")
        .agg(F.max("section_num").alias("section_num"))
    )


def link_sections(links: DataFrame, sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Section every link points to: by address, else by base name; others dropped."""
    names = section_names(sections, keys)
    target = without_fragment(F.col("href"))
    by_address = names.select(*keys, F.col("name").alias("__a"), F.col("section_num").alias("__full"))
    by_name = names.select(*keys, F.col("name").alias("__b"), F.col("section_num").alias("__base"))
    return (
        links.withColumns({"__a": target, "__b": base_name(target)})
        .join(by_address, [*keys, "__a"], "left")
        .join(by_name, [*keys, "__b"], "left")
        .withColumn("section_num", F.coalesce("__full", "__base"))
        .filter("section_num is not null")
        .drop("__a", "__b", "__full", "__base")
    )
