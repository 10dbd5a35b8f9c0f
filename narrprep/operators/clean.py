"""Whole cleaning chain over a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.abbreviations import expand_abbreviations
from ..functions.language import with_language


def clean_documents(
    df: DataFrame,
    text: str = "text",
    out: str = "clean",
    language: str | None = None,
    rules=None,
    rules_first: bool = False,
) -> DataFrame:
    """Detect the language on the raw text, then clean it; no shuffle.

    ``rules`` is a :class:`~narrprep.operators.rules.RuleSet`.  Built-in
    abbreviations run before the rules, so a rule for ``etc.`` has nothing
    left to replace; ``rules_first`` turns that round.
    """
    if language is None:
        df = with_language(df, text, "detected")
    else:
        df = df.withColumn("detected", F.lit(language))
    c = T.replace_ligatures(F.col(text))
    c = T.plain_characters(c)
    c = T.rejoin_hyphenated(c)
    c = T.drop_page_artifacts(c)
    if rules is not None and rules_first:
        c = rules.apply(c)
    c = expand_abbreviations(c, F.col("detected"))
    if rules is not None and not rules_first:
        c = rules.apply(c)
    c = T.space_numbers(c)
    c = T.normalize_punctuation(c)
    return df.withColumn(out, T.normalize_whitespace(c))
