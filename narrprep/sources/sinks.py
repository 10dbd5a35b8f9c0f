"""Text export, chapter listings and staged tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import bucket_of
from ..session import stage

RULER = "=" * 60
METADATA_FIELDS = ["title", "author", "subject", "creator", "producer", "page_count"]


def listing_line(number: Column, title: Column, start: Column, unit: str = "page") -> Column:
    """``1. Title (page 3)``; no page where the start is not known."""
    place = F.when(F.coalesce(start, F.lit(0)) > 0, F.concat(F.lit(f" ({unit} "), start.cast("string"), F.lit(")")))
    return F.concat(number.cast("string"), F.lit(". "), title, F.coalesce(place, F.lit("")))


def chapter_listing(chapters: DataFrame, keys: Sequence[str], unit: str = "page") -> DataFrame:
    """Number, title and start of every chapter; ``?`` where the start is not known."""
    start = F.col("start_section")
    shown = F.when(F.coalesce(start, F.lit(0)) > 0, start.cast("string")).otherwise(F.lit("?"))
    return chapters.select(
        *keys,
        "chapter_no",
        "title",
        shown.alias("start"),
        listing_line(F.col("chapter_no"), F.col("title"), start, unit).alias("line"),
    )


def _block(title: str) -> Column:
    return F.lit(f"{RULER}\n{title}\n{RULER}")


def metadata_lines(metadata: str = "metadata") -> Column:
    """``key: value`` lines of the fields that have a value."""
    lines = []
    for name in METADATA_FIELDS:
        value = F.col(f"{metadata}.{name}").cast("string")
        shown = (value != "") & (value != "0")
        lines.append(F.when(shown, F.concat(F.lit(f"{name}: "), value)))
    return F.array_compact(F.array(*lines))


def export_text(metadata: str, listing: str, text: str, include_meta: bool = True) -> Column:
    """Text of a book with METADATA, CHAPTERS and TEXT blocks in front.

    ``listing`` is an array of chapter lines in the same row; without entries
    the CHAPTERS block is left out.
    """
    if not include_meta:
        return F.col(text)
    fields = F.array_join(
        F.transform(metadata_lines(metadata), lambda line: F.concat(line, F.lit("\n"))), ""
    )
    header = F.concat(_block("METADATA"), F.lit("\n"), fields, F.lit("\n"))
    chapters = F.when(
        F.size(listing) > 0,
        F.concat(_block("CHAPTERS"), F.lit("\n"), F.array_join(listing, "\n"), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    return F.concat(header, chapters, _block("TEXT"), F.lit("\n\n"), F.col(text))


def write_text(exported: DataFrame, path: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Exports as text files by document bucket, a form feed behind each."""
    (
        exported.select(F.col("export").alias("value"), bucket_of(key, buckets).alias("doc_bucket"))
        .hint("rebalance", "doc_bucket")
        .write.mode("overwrite")
        .partitionBy("doc_bucket")
        .option("lineSep", "\f")
        .text(path)
    )


def write_chunks(chunks: DataFrame, path: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Chunk or timeline rows by document bucket; all rows of the documents written are replaced, no others.

    Buckets written to are rewritten with what they held of other documents.
    """
    rows = chunks.withColumn("doc_bucket", bucket_of(key, buckets))
    spark = chunks.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        stored = spark.read.schema(rows.schema).parquet(path)
        others = stored.join(rows.select("doc_bucket").distinct(), "doc_bucket", "left_semi").join(
            rows.select(F.col(key).alias("written")).distinct(), F.col(key).eqNullSafe(F.col("written")), "left_anti"
        )
        # The buckets are read before they are replaced.
        rows = stage(rows.unionByName(others.select(*rows.columns)), "chunk-buckets")
    (
        rows
        .hint("rebalance", "doc_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("doc_bucket")
        .parquet(path)
    )
