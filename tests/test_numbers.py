import hashlib
import json

import pytest
from pyspark.sql import functions as F

from narrprep.functions import numbers as N
from narrprep.operators.timeline import with_durations


@pytest.mark.parametrize(
    "text, value",
    [("I", 1), ("V", 5), ("IV", 4), ("IX", 9), ("XLII", 42), ("MCMXCIV", 1994), ("iv", 4), ("IIII", 4), ("ABC", None), ("", None)],
)
def test_roman(one, text, value):
    assert one(N.roman_to_int, text) == value


@pytest.mark.parametrize("text, value", [("1", 1), ("42", 42), (" 5 ", 5), ("IV", 4), ("XII", 12), ("abc", None)])
def test_chapter_number(one, text, value):
    assert one(N.chapter_number, text) == value


@pytest.mark.parametrize(
    "seconds, text",
    [(30.5, "00:00:30.500"), (90.123, "00:01:30.123"), (3661.0, "01:01:01.000"), (0.0, "00:00:00.000")],
)
def test_clock_millis(one, seconds, text):
    assert one(N.clock_millis, seconds, "double") == text


def test_clock(one):
    assert one(N.clock, 3725.9, "double") == "01:02:05"


@pytest.mark.parametrize("words, wpm, seconds", [(150, 150, 60.0), (0, 150, 0.0), (100, 100, 60.0)])
def test_spoken_seconds(one, words, wpm, seconds):
    assert one(lambda c: N.spoken_seconds(c, wpm), " ".join(["word"] * words)) == pytest.approx(seconds)


def test_chunk_samples_are_clamped(spark):
    texts = [("word " * 5,), ("x",), ("w " * 400,), ("  ",)]
    rows = with_durations(spark.createDataFrame(texts, "text string"), speed=2.0).collect()
    assert [r["n_samples"] for r in rows] == [24_000, 4_800, 1_440_000, 0]
    fast = with_durations(spark.createDataFrame([("x",)], "text string"), speed=8.0).first()
    assert fast["n_samples"] == 2_400


def test_silence():
    assert N.silence_samples(1.0) == 24_000 and N.silence_samples(0.5) == 12_000


def test_settings_fingerprint_ignores_order():
    a = {"voice": "v", "speed": 1.0}
    expected = hashlib.sha256(json.dumps(a, sort_keys=True).encode()).hexdigest()[:16]
    assert N.settings_fingerprint(a) == N.settings_fingerprint(dict(reversed(a.items()))) == expected


def test_labels_and_millis(spark):
    row = spark.range(1).select(
        N.chunk_label(F.lit(7)).alias("l"), N.samples_millis(F.lit(36_024)).alias("m"), N.samples_clock(F.lit(24_000 * 61)).alias("c")
    ).first()
    assert (row.l, row.m, row.c) == ("000007", 1501, "00:01:01")


def test_iso_utc(spark):
    assert spark.sql("select timestamp'2024-01-02 03:04:05.5' t").select(N.iso_utc(F.col("t"))).first()[0] == "2024-01-02T03:04:05.500000+00:00"
