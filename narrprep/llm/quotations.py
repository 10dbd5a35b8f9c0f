"""Conversations in reply order, without the quotations in their messages.

A line that begins with ``>`` signs is quoted, as deep as there are signs.  Neighbouring quoted lines of one depth are
a passage.  Passages and their lines are hashed after normalising, as are the own lines, paragraphs and whole own
text of every message; a quoting message replies to the earlier message of its conversation that matches most of its
outermost quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import asof_backward
from ..session import stage

#: Turns in a block of a conversation, and in a block of the ordered search for originals.
BLOCK = 256
_QUOTED = r"^[ \t]*>"
_SIGNS = r"^([ \t]*>)+"
MESSAGE = ["conv_id", "turn", "role", "text"]


def _lines(text: Column) -> Column:
    """Lines with their depth and the text behind the signs."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\r?\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _SIGNS, 0), "[^>]", "")).alias("depth"),
            F.regexp_replace(x, _SIGNS, "").alias("line"),
        ),
    )


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def own_text(text: Column) -> Column:
    """The text without quoted lines, blanks around it cut."""
    own = F.filter(_lines(text), lambda x: x["depth"] == 0)
    return F.regexp_replace(F.concat_ws("\n", F.transform(own, lambda x: x["line"])), r"^\s+|\s+$", "")


def passages(text: Column) -> Column:
    """Quoted passages: depth, and the normalised lines that are not empty."""
    lines = _lines(F.replace(text, F.lit("\x00"), F.lit("")))
    # A passage begins where the depth changes; every line carries the number of the passage it lies in.
    starts = F.transform(lines, lambda x, i: (i == 0) | (x["depth"] != F.get(lines, i - 1)["depth"]))
    joined = F.concat_ws(
        "\n", F.transform(F.arrays_zip(lines.alias("x"), starts.alias("new")),
                          lambda z: F.concat(F.when(z["new"], F.lit("\x00")).otherwise(F.lit("")), z["x"]["depth"].cast("string"), F.lit(" "), z["x"]["line"]))
    )
    parts = F.filter(F.split(joined, "\x00", -1), lambda p: p.rlike("^[1-9]"))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\d+) ", 1).cast("int").alias("depth"),
            F.filter(F.transform(F.split(p, "\n", -1), lambda x: _normal(F.regexp_replace(x, r"^\d+ ", ""))), lambda x: x != "").alias("lines"),
        ),
    )


def _unit(normal: Column) -> Column:
    return F.struct(F.md5(normal).alias("unit"), F.length(normal).alias("size"))


def _quoted_units(quoting: DataFrame) -> DataFrame:
    each = quoting.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p"))
    units = F.array_distinct(F.concat(F.col("p.lines"), F.array(F.concat_ws(" ", "p.lines"))))
    units = each.select("conv_id", "turn", F.col("p.depth").alias("depth"), F.explode(F.filter(units, lambda x: x != "")).alias("x"))
    return units.select("conv_id", "turn", "depth", _unit(F.col("x")).alias("u")).select("conv_id", "turn", "depth", "u.*").distinct()


def _own_units(messages: DataFrame) -> DataFrame:
    own = messages.select("conv_id", "turn", own_text(F.col("text")).alias("own"))
    units = F.concat(F.split("own", "\n", -1), F.split("own", r"\n\s*\n", -1), F.array("own"))
    units = F.array_distinct(F.filter(F.transform(units, _normal), lambda x: x != ""))
    return own.select("conv_id", "turn", F.explode(units).alias("x")).select("conv_id", F.md5("x").alias("unit"), F.col("turn").alias("original")).distinct()


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn`` and ``original`` of every message that quotes an earlier one of its conversation."""
    quoting = messages.filter(F.coalesce(F.col("text"), F.lit("")).rlike("(?m)" + _QUOTED))
    quoted = stage(_quoted_units(quoting), "quotes-units")
    # Only what is quoted is looked for among own texts; of several originals the latest before the quotation counts.
    asked = quoted.select("conv_id", "unit").distinct()
    own = _own_units(messages).join(asked, ["conv_id", "unit"], "left_semi")
    met = asof_backward(
        quoted.withColumn("before", F.col("turn") - 1), own, ["conv_id", "unit"], "before", "original", ["original"], BLOCK
    ).filter("original is not null")
    scored = met.groupBy("conv_id", "turn", "depth", "original").agg(F.sum("size").alias("size"))
    best = F.max_by("original", F.struct(-F.col("depth"), F.col("size"), F.col("original")))
    return scored.groupBy("conv_id", "turn").agg(best.alias("original"))


def _threads(links: DataFrame) -> DataFrame:
    """First message of the chain of originals behind every quoting message, by doubling the steps."""
    now = stage(links.withColumnRenamed("original", "root"), "quotes-roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        further = now.join(up, ["conv_id", "root"], "left")
        if further.filter("above is not null").isEmpty():
            return now
        now = stage(further.select("conv_id", "turn", F.coalesce("above", "root").alias("root")), "quotes-roots")


def replies(messages: DataFrame) -> DataFrame:
    """Messages with ``original`` (turn quoted, null if none), ``thread`` (turn its chain of quotations leads to, its
    own if it quotes nothing) and ``own`` (text without quotations)."""
    rows = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), "text",
    ).distinct()
    known = rows.filter("conv_id is not null and turn is not null")
    links = stage(reply_links(known), "quotes-links")
    threads = _threads(links).withColumnRenamed("root", "thread")
    return (
        rows.join(links.join(threads, ["conv_id", "turn"]), ["conv_id", "turn"], "left")
        .select(*MESSAGE, "original", F.coalesce("thread", "turn").alias("thread"), own_text(F.col("text")).alias("own"))
    )


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Conversations as text, in blocks: ``conv_id``, ``thread_block``, ``turn_block``, ``n_messages``, ``n_replies``
    and ``chat``, one ``role: text`` after the other.

    Inside a conversation messages stand by blocks of threads, blocks of turns, thread and turn, so a reply stands
    behind the message it quotes, and a block holds ``block`` turns of ``block`` threads at most, however long the
    conversation.  Repeated messages count once; different messages with one turn stand in order of role and text.
    A message without conversation or turn is a conversation of its own, with null blocks.  A null text is an
    empty one, a null role reads ``unknown``.  A quotation without an original is dropped like others.  Messages
    without own text stay, empty.  An empty table gives an empty one; other columns are ignored.
    """
    told = replies(messages)
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    line = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.col("own"))
    at = F.struct("thread", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.col("text").alias("text"), line.alias("line"))
    keyed = told.select(
        "conv_id",
        F.when(~alone, F.floor(F.col("thread") / block)).alias("thread_block"),
        F.when(~alone, F.floor(F.col("turn") / block)).alias("turn_block"),
        F.when(alone, F.md5(F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}))).alias("own_key"),
        "original", at.alias("at"),
    )
    grouped = keyed.groupBy("conv_id", "thread_block", "turn_block", "own_key").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count("original").alias("n_replies"), F.array_sort(F.collect_list("at")).alias("all")
    )
    return grouped.select(
        "conv_id", "thread_block", "turn_block", "n_messages", "n_replies", F.concat_ws("\n", F.col("all.line")).alias("chat")
    )
