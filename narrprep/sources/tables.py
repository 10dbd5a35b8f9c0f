"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_to_text, meta_value, page_title


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where the scan has too few splits to balance itself.

    Text work is bound by the processor, and a split holds rows only where a
    row group starts, so a small table may run in one task.  A scan of two or
    more splits per core is left as it is: a large corpus is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores)


def read_texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(read_table(spark, folder, name))


def html_sections(pages: DataFrame, html: str = "html") -> DataFrame:
    """Markup pages as text sections."""
    return pages.withColumn("text", html_to_text(F.col(html))).drop(html)


def with_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Struct of the six metadata fields; a field that is missing is empty."""
    c = F.col(html)
    return pages.withColumn(
        "metadata",
        F.struct(
            page_title(c).alias("title"),
            meta_value(c, "author").alias("author"),
            meta_value(c, "description").alias("subject"),
            meta_value(c, "generator").alias("creator"),
            meta_value(c, "publisher").alias("producer"),
            F.lit(1).alias("page_count"),
        ),
    )
