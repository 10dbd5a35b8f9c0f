"""File manifests, format routing and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import content_fingerprint
from ..functions.text import strip, strip_export_header, suffix

# Input and output formats by extension, and media types.
INPUT_FORMATS = {".pdf": "pdf", ".epub": "epub"}
OUTPUT_FORMATS = {".wav": "wav", ".mp3": "mp3", ".m4b": "m4b", ".m4a": "m4b", ".aac": "m4b"}
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".epub": "application/epub+zip",
    ".wav": "audio/wav",
    ".mp3": "audio/mpeg",
    ".m4b": "audio/mp4",
}
OTHER_MEDIA_TYPE = "application/octet-stream"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def with_format(files: DataFrame, path: str = "path", direction: str = "input") -> DataFrame:
    """Add extension, format (null when unknown) and media type."""
    table = INPUT_FORMATS if direction == "input" else OUTPUT_FORMATS
    return files.withColumn("extension", suffix(F.col(path))).withColumns(
        {
            "format": _lookup(table, F.col("extension")),
            "media_type": F.coalesce(_lookup(MEDIA_TYPES, F.col("extension")), F.lit(OTHER_MEDIA_TYPE)),
        }
    )


def route_files(files: DataFrame, path: str = "path", direction: str = "input") -> tuple[DataFrame, DataFrame]:
    """Files of a known format, and the rejected ones with the reason."""
    routed = with_format(files, path, direction)
    rejected = routed.filter("format is null").withColumn(
        "reason", F.concat(F.lit("no reader for "), F.coalesce(F.nullif("extension", F.lit("")), F.lit("unknown")))
    )
    return routed.filter("format is not null"), rejected


def file_manifest(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Path, size, time and content fingerprint of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", "length", "modificationTime", content_fingerprint(F.col("content")).alias("input_hash")
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files without the header of a text export."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), strip(strip_export_header(F.col("value"))).alias("text")
    )
