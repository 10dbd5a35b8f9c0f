"""Voice catalogue and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Voice name, language code, description.
VOICES = [
    ("af_heart", "a", "American English Female - Heart (A grade)"),
    ("af_bella", "a", "American English Female - Bella (A- grade)"),
    ("af_nicole", "a", "American English Female - Nicole"),
    ("af_sarah", "a", "American English Female - Sarah"),
    ("af_sky", "a", "American English Female - Sky"),
    ("am_fenrir", "a", "American English Male - Fenrir"),
    ("am_michael", "a", "American English Male - Michael"),
    ("am_puck", "a", "American English Male - Puck"),
    ("am_adam", "a", "American English Male - Adam"),
    ("bf_emma", "b", "British English Female - Emma (B- grade)"),
    ("bf_isabella", "b", "British English Female - Isabella"),
    ("bf_alice", "b", "British English Female - Alice"),
    ("bm_george", "b", "British English Male - George"),
    ("bm_lewis", "b", "British English Male - Lewis"),
    ("bm_daniel", "b", "British English Male - Daniel"),
    ("ef_dora", "e", "Spanish Female - Dora"),
    ("em_alex", "e", "Spanish Male - Alex"),
    ("ff_siwis", "f", "French Female - Siwis (B- grade)"),
    ("jf_alpha", "j", "Japanese Female - Alpha"),
    ("jm_kumo", "j", "Japanese Male - Kumo"),
    ("zf_xiaobei", "z", "Chinese Female - Xiaobei"),
    ("zm_yunjian", "z", "Chinese Male - Yunjian"),
]

# Names of the language codes.
LANGUAGE_NAMES = {
    "a": "American English",
    "b": "British English",
    "e": "Spanish",
    "f": "French",
    "j": "Japanese",
    "z": "Chinese",
    "h": "Hindi",
    "i": "Italian",
    "p": "Portuguese",
}
DEFAULT_CODE = "a"


def voice_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICES, "voice string, lang_code string, description string").withColumn(
        "lang_name", language_name(F.col("lang_code"))
    )


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def list_voices(spark: SparkSession, lang_code: str | None = None) -> DataFrame:
    voices = voice_table(spark)
    if lang_code is not None:
        voices = voices.filter(F.col("lang_code") == lang_code)
    return voices.orderBy("voice")


def voices_by_language(voices: DataFrame) -> DataFrame:
    """Voices of every language; the catalogue is small, so a list per row is fine."""
    return voices.groupBy("lang_code", "lang_name").agg(F.array_sort(F.collect_set("voice")).alias("voices"))


def route_voices(rows: DataFrame, voice: str = "voice") -> DataFrame:
    """Language of every row's voice.

    The catalogue is a fixed list of 22 rows, so it is broadcast.  An unknown
    voice takes the code of its first letter where voices with that code
    exist, else American English.
    """
    catalogue = voice_table(rows.sparkSession).select(
        F.col("voice").alias(voice), F.col("lang_code").alias("__code"), "description"
    )
    codes = sorted({code for _, code, _ in VOICES})
    first = F.substring(voice, 1, 1)
    inferred = F.when(first.isin(codes), first).otherwise(F.lit(DEFAULT_CODE))
    return (
        rows.join(F.broadcast(catalogue), voice, "left")
        .withColumn("lang_code", F.coalesce("__code", inferred))
        .withColumn("lang_name", language_name(F.col("lang_code")))
        .drop("__code")
    )
