"""Removal of lines that stand on many sites, with DataFrame functions only.

The spread of a line is the number of distinct sites that hold it, and of distinct texts, so that copies of one page
on many sites do not make its lines boilerplate.  Both are sketched with HyperLogLog, which merges on the map side
and keeps a line of any frequency at a fixed size.  A line whose sketches lie clear of the thresholds is decided by
them; one near a threshold is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ROW, fresh, row_key

#: Registers of a sketch, as a power of two: 1.6 % standard error, exact in effect below a few hundred.
REGISTERS = 12
#: Sketches within this part of a threshold are counted exactly; over ten standard errors.
NEAR = 0.2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    """128 bits of a line without the blanks around it."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def line_spread(docs: DataFrame, min_sites: int, min_texts: int, site: str) -> DataFrame:
    """Keys of the lines found on ``min_sites`` sites and in ``min_texts`` texts at least, with exact decisions."""
    rows = docs.select(
        *row_key(F.col("doc_id"), F.col("text")), F.col(site).cast("string").alias("site"), F.explode(_lines(F.col("text"))).alias("line")
    )
    rows = rows.filter("trim(line) <> ''").select(_line_key(F.col("line")).alias("line"), "site", ROW[1])
    sketched = rows.groupBy("line").agg(
        F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sites"), F.hll_sketch_agg(ROW[1], F.lit(REGISTERS)).alias("texts")
    )
    least = [(F.hll_sketch_estimate("sites"), min_sites), (F.hll_sketch_estimate("texts"), min_texts)]
    may = [found >= F.lit(most * (1 - NEAR)) for found, most in least]
    sure = [found > F.lit(most * (1 + NEAR)) for found, most in least]
    spread = stage(sketched.filter(may[0] & may[1]).select("line", (sure[0] & sure[1]).alias("sure")), "line-spread")
    exact = (
        rows.join(spread.filter("not sure").select("line"), "line")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"), F.count_distinct(ROW[1]).alias("texts"))
        .filter((F.col("sites") >= min_sites) & (F.col("texts") >= min_texts))
    )
    return spread.filter("sure").select("line").unionByName(exact.select("line"))


def line_dedup(
    docs: DataFrame, min_sites: int = 8, min_texts: int = 8, site: str = "source"
) -> DataFrame:
    """Documents without the lines that stand on ``min_sites`` sites and in ``min_texts`` different texts or more.

    Adds ``n_lines`` and ``n_removed`` and changes ``text`` (and ``n_chars``, if there is one) of documents that lose
    a line; all rows and columns stay.  Lines end with a line feed; blanks around a line do not count.  Blank
    lines are never removed.  A null text stays null and has no lines; an empty one has one blank line.  Rows with a
    null site lose lines but vouch for no site.  Copies of a row count as one text.  An empty table gives an
    empty one.  Existing columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    common = stage(line_spread(docs, min_sites, min_texts, site), "line-common")
    held = docs.select(*row_key(F.col("doc_id"), F.col("text")), F.explode(_lines(F.col("text"))).alias("line"))
    held = held.filter("trim(line) <> ''").select(*ROW, _line_key(F.col("line")).alias("line"))
    found = held.join(common, "line").groupBy(*ROW).agg(F.collect_set("line").alias("drop"))
    keys = [fresh(docs, name) for name in (*ROW, "drop", "kept")]
    doc, text = row_key(F.col("doc_id"), F.col("text"))
    found = found.select(*[F.col(a).alias(b) for a, b in zip((*ROW, "drop"), keys, strict=False)])
    joined = docs.withColumns({keys[0]: doc, keys[1]: text}).join(found, keys[:2], "left")
    lines = _lines(F.col("text"))
    joined = joined.withColumn(
        keys[3], F.when(F.col(keys[2]).isNotNull(), F.filter(lines, lambda x: ~F.array_contains(F.col(keys[2]), _line_key(x))))
    )
    lost = F.col(keys[3]).isNotNull()
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint")
    out = {
        "n_lines": n_lines,
        "n_removed": F.when(lost, n_lines - F.size(keys[3])).otherwise(F.lit(0)).cast("bigint"),
        "text": F.when(lost, F.concat_ws("\n", keys[3])).otherwise(F.col("text")),
    }
    if "n_chars" in docs.columns:
        n_chars = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(lost, F.length(out["text"]).cast(n_chars)).otherwise(F.col("n_chars"))
    return joined.withColumns(out).drop(*keys)


def line_dedup_sql(min_sites: int = 8, min_texts: int = 8) -> str:
    """The same in SQL, counted exactly."""
    return f"""
    with lines as (
        select source, text, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents
    ), common as (
        select coalesce(list(line), []) as lines from (
            select trim(line, ' ') as line from lines where trim(line, ' ') <> ''
            group by 1 having count(distinct source) >= {min_sites} and count(distinct text) >= {min_texts}
        )
    ), split as (
        select doc_id, text is null as missing, string_split(coalesce(text, ''), chr(10)) as every,
            list_filter(every, lambda x: not list_contains(lines, trim(x, ' '))) as kept
        from documents, common
    )
    select doc_id, case when missing then 0 else len(every) end::bigint as n_lines,
        (len(every) - len(kept))::bigint as n_removed,
        case when not missing then array_to_string(kept, chr(10)) end as text
    from split
    """
