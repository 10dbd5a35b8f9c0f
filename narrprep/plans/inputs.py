"""Texts and logs the registered queries derive from the input tables.

The documents hold no headings, blank lines or abbreviations, so queries that
need them put them in by a fixed expression over every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_column
from ..functions.numbers import content_fingerprint, settings_fingerprint, spoken_samples
from ..functions.packing import paragraphs, sentences
from ..functions.text import word_count
from ..operators.timeline import with_durations
from ..session import stage
from ..sources.tables import read_table, read_texts

# Text put in front of and behind every document for the cleaning queries.
DAMAGE_HEAD = (
    "“Dr. ﬁrst” and Mrs. Lee-\nWong paid $5 — or €7… on Jan. 3 (call 555-123-4567 ) ; ok!!\n"
    " 12 \nPage 3\n-----\nvs.the rest??\n\n\n"
)
DAMAGE_TAIL = "\n\n  Prof. Ruiz, etc.\n  \nat 5 p.m. in St. Ives ( end )\n42"

# Settings whose fingerprint stands for the current run.
RUN_SETTINGS = {"voice": "af_heart", "speed": 1.0, "dict_path": None, "chapters": None}
OLD_SETTINGS = {"voice": "bf_emma", "speed": 1.0, "dict_path": None, "chapters": None}
RUN_HASH = settings_fingerprint(RUN_SETTINGS)
OLD_HASH = settings_fingerprint(OLD_SETTINGS)

# A small rule table that the rule queries apply to the documents.
DEMO_RULES = [
    ("words", "the", "thee"),
    ("words", "und", "oont"),
    ("words", "que", "kay"),
    ("acronyms", "NATO", "NAY-toh"),
    ("acronyms", "SQL", "sequel"),
    ("abbreviations", "no.", "number"),
    ("abbreviations", "approx.", "roughly"),
    ("patterns", r"([0-9]+)km", r"\1 kilometers"),
    ("patterns", r"\$([0-9]+)", r"\1 dollars"),
    ("patterns", r"broken(", "never used"),
]

STATUS_OF = {
    "signup": "pending",
    "click": "processing",
    "view": "processing",
    "purchase": "completed",
    "error": "failed",
}


def documents(spark, sf) -> DataFrame:
    return read_texts(spark, sf, "documents")


def damaged(spark, sf) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", "lang", F.concat(F.lit(DAMAGE_HEAD), "text", F.lit(DAMAGE_TAIL)).alias("text")
    )


def paragraphed(spark, sf) -> DataFrame:
    """Documents with every line as a paragraph of its own."""
    return documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def books(spark, sf) -> DataFrame:
    """Every document as a book with headings, one of them over a short chapter."""
    return documents(spark, sf).select(
        "doc_id",
        "lang",
        "source",
        F.concat(
            F.lit("Prologue\n\n"), "text",
            F.lit("\n\n  Chapter "), F.col("doc_id").cast("string"), F.lit(": Of "), "source",
            F.lit("\n\n"), "text",
            F.lit("\n\nCAPÍTULO IX. Cierre\nshort\nIntroductions are no heading\nEpilogue - End\n\n"), "text",
            F.lit("\nPart II\n"),
        ).alias("text"),
    )


def section_lengths(spark, sf) -> DataFrame:
    """Length and spoken samples of every document, from one pass over the texts."""
    return stage(
        documents(spark, sf).select(
            "source",
            "doc_id",
            F.length("text").cast("bigint").alias("n_chars"),
            spoken_samples(word_count(F.col("text"))).alias("n_samples"),
        ),
        "lengths",
    )


def source_sections(spark, sf) -> DataFrame:
    """Documents as numbered sections of the book that is their source."""
    return documents(spark, sf).select(
        "source",
        F.col("doc_id").alias("section_num"),
        "lang",
        F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit(". In "), "lang", F.lit("\n\n"), "text").alias("text"),
    )


def book_chunks(spark, sf) -> DataFrame:
    """Sentences as chunks of the book that is their source, with durations.

    A document is a chapter, German ones belong to none.  A pause follows the
    last sentence of a paragraph, except the last one of the document.
    """
    paras = paragraphed(spark, sf).select(
        "source",
        "doc_id",
        F.when(F.col("lang") != "de", F.col("doc_id")).alias("chapter_no"),
        paragraphs(F.col("text")).alias("paras"),
    )
    by_para = explode_column(
        paras.withColumn("n_paras", F.size("paras")),
        ["source", "doc_id", "chapter_no", "n_paras"], "paras", "para_idx", "p",
    ).withColumn("sents", sentences(F.col("p")))
    rows = explode_column(
        by_para.withColumn("n_sents", F.size("sents")),
        ["source", "doc_id", "chapter_no", "n_paras", "para_idx", "n_sents"], "sents", "sent_idx", "text",
    )
    breaks = (F.col("sent_idx") == F.col("n_sents") - 1) & (F.col("para_idx") < F.col("n_paras") - 1)
    return with_durations(rows).select(
        "source", "doc_id", "para_idx", "sent_idx", "chapter_no", "n_samples",
        breaks.alias("paragraph_break_after"),
    )


def paragraph_rows(spark, sf) -> DataFrame:
    """Lines of the documents as chunks of a run, with its keys."""
    return paragraphed(spark, sf).select(
        "doc_id",
        content_fingerprint(F.col("text")).alias("input_hash"),
        F.lit(RUN_HASH).alias("settings_hash"),
        F.posexplode(paragraphs(F.col("text"))).alias("chunk_idx", "text"),
    )


def labels(spark, sf) -> DataFrame:
    return read_table(spark, sf, "labels")


def job_log(spark, sf) -> DataFrame:
    return as_job_log(read_table(spark, sf, "events"))


def as_job_log(events: DataFrame) -> DataFrame:
    """Events as a job log: the user is the job, the event type its stage."""
    stage = F.col("event_type")
    status: Column = F.lit(None).cast("string")
    for name, value in STATUS_OF.items():
        status = F.when(stage == name, F.lit(value)).otherwise(status)
    return events.select(
        F.col("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        status.alias("status"),
        stage.alias("stage"),
        F.col("value").alias("percent"),
        F.get_json_object("props", "$.k").cast("int").alias("chunk"),
        F.concat(F.lit("at "), stage).alias("message"),
    )


def jobs(spark, sf) -> DataFrame:
    """Orders as jobs of their customers."""
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("processing")
        .alias("status"),
        (F.col("o_orderkey") % 12 / 5.0).alias("speed"),
        F.when(
            F.col("o_orderpriority") != "5-LOW",
            F.concat(
                F.lit("["), (F.col("o_orderkey") % 7).cast("string"), F.lit(", "),
                F.substring("o_orderpriority", 1, 1), F.lit("]"),
            ),
        ).alias("chapters_to_convert"),
    )
