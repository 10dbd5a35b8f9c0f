"""Language detection by marker words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .charclass import LEFT_EDGE, RIGHT_EDGE, any_of
from .text import word_count

# Frequent words by which a language is recognised.
MARKERS = {
    "es": (
        "el la los las de del que en y a por con para su se no "
        "como más pero sus es era sí yo"
    ).split(),
    "en": (
        "the and of to a in that is was he for it with as his on "
        "be at by i this had not are"
    ).split(),
}
MIN_WORDS = 5
MIN_RATIO = 0.05


def marker_hits(text: Column, words: list[str]) -> Column:
    """Array of the whole words of ``words`` in a text, in lower case.

    The first letters are tested before the word boundary is looked back for.
    """
    first = "".join(sorted({word[0] for word in words}))
    pattern = f"(?=[{first}])" + LEFT_EDGE + any_of(words) + RIGHT_EDGE
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def _one_of(words: list[str]):
    return lambda w: w.isin(*words)


def with_language(
    df: DataFrame,
    text: str = "text",
    out: str = "detected",
    keep_counts: bool = False,
    markers: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Add the detected language; ``unknown`` when short, unclear or tied."""
    tables = markers or MARKERS
    every = sorted({word for words in tables.values() for word in words})
    df = df.withColumn("n_words", word_count(F.col(text)))
    df = df.withColumn("__hits", marker_hits(F.col(text), every))
    df = df.withColumns(
        {
            f"{lang}_hits": F.size(F.filter("__hits", _one_of(words)))
            for lang, words in tables.items()
        }
    ).drop("__hits")
    result = F.lit("unknown")
    for lang in tables:
        ratio = F.try_divide(F.col(f"{lang}_hits"), F.col("n_words"))
        ahead = F.lit(True)
        for other in tables:
            if other != lang:
                ahead = ahead & (F.col(f"{lang}_hits") > F.col(f"{other}_hits"))
        result = F.when(
            (F.col("n_words") >= MIN_WORDS) & ahead & (ratio > F.lit(MIN_RATIO)), F.lit(lang)
        ).otherwise(result)
    df = df.withColumn(out, result)
    if keep_counts:
        return df
    return df.drop("n_words", *[f"{lang}_hits" for lang in tables])
