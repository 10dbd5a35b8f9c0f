"""Numerals, durations, time text and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, word_count

# Speech timing.
SAMPLE_RATE = 24_000
WORDS_PER_MINUTE = 150
MIN_SECONDS = 0.1
MAX_SECONDS = 60.0
PARAGRAPH_PAUSE = 0.5
CHAPTER_PAUSE = 1.5

# Roman digits.
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_to_int(c: Column) -> Column:
    """Value of a Roman numeral (lenient, any case); null when it is none."""
    digits = F.create_map(*[F.lit(x) for pair in ROMAN_DIGITS.items() for x in pair])

    def step(acc: Column, ch: Column) -> Column:
        value = F.try_element_at(digits, ch)
        signed = F.when(value < acc["prev"], -value).otherwise(value)
        return F.struct((acc["total"] + signed).alias("total"), value.alias("prev"))

    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))
    upper = F.upper(c)
    total = F.aggregate(F.reverse(F.split(upper, "")), zero, step, lambda acc: acc["total"])
    return F.when(upper.rlike(r"\A[IVXLCDM]+\z") & (total > 0), total)


def chapter_number(c: Column) -> Column:
    """Chapter number written in digits or as a Roman numeral."""
    s = strip(c)
    return F.when(s.rlike(r"\A[0-9]+\z"), s.try_cast("int")).otherwise(roman_to_int(s))


def spoken_seconds(text: Column, words_per_minute: float = WORDS_PER_MINUTE) -> Column:
    return word_count(text) / F.lit(float(words_per_minute)) * F.lit(60.0)


def spoken_samples(
    n_words: Column, speed: float | Column = 1.0, sample_rate: int = SAMPLE_RATE
) -> Column:
    """Samples of one chunk at 150 words a minute, 0.1 to 60 s; 0 without words."""
    rate = speed if isinstance(speed, Column) else F.lit(float(speed))
    seconds = n_words / F.lit(float(WORDS_PER_MINUTE)) * F.lit(60.0) / rate
    clamped = F.greatest(F.lit(MIN_SECONDS), F.least(seconds, F.lit(MAX_SECONDS)))
    return F.when(n_words > 0, F.floor(clamped * F.lit(sample_rate))).otherwise(F.lit(0)).cast("bigint")


def silence_samples(seconds: float, sample_rate: int = SAMPLE_RATE) -> int:
    return int(seconds * sample_rate)


def clock_millis(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``"""
    return F.format_string(
        "%02d:%02d:%06.3f",
        F.floor(seconds / 3600).cast("bigint"),
        F.floor((seconds % 3600) / 60).cast("bigint"),
        (seconds % 60).cast("double"),
    )


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``, fractions cut off."""
    whole = F.floor(seconds).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600).cast("bigint"),
        F.floor((whole % 3600) / 60).cast("bigint"),
        whole % 60,
    )


def samples_clock(samples: Column, sample_rate: int = SAMPLE_RATE) -> Column:
    return clock(samples / F.lit(float(sample_rate)))


def samples_millis(samples: Column, sample_rate: int = SAMPLE_RATE) -> Column:
    """Whole milliseconds of a sample position, cut off after seconds are doubles."""
    return F.floor(samples / F.lit(float(sample_rate)) * F.lit(1000.0)).cast("bigint")


def settings_fingerprint(settings: dict) -> str:
    """16 hex digits that do not depend on the order of the settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def content_fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_label(idx: Column) -> Column:
    """At least six digits; longer numbers stay whole."""
    digits = idx.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))


def iso_utc(ts: Column) -> Column:
    """Time as ISO text; sessions run in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def expired(until: Column) -> Column:
    return F.current_timestamp() > until
