"""Books of many rows give what the same book gives in one row."""

import random

import pytest
from pyspark.sql import functions as F

from narrprep.operators.chunks import chunk_documents, merged_across_rows, merged_chunks, packed_chunks
from narrprep.plans.books import narrate_books
from narrprep.plans.narrate import narration, narration_chunks


def sentence(rng):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 14))) + rng.choice(".!?")


def section(rng):
    parts = []
    for _ in range(rng.randrange(0, 4)):
        if rng.random() < 0.15:
            parts.append(f"Chapter {rng.randrange(1, 40)}: Some title")
        parts.append(" ".join(sentence(rng) for _ in range(rng.randrange(1, 5))))
        if rng.random() < 0.3:
            parts.append(rng.choice(["Oh.", "No!", "x", "A bit more."]))
    return "\n\n".join(parts)


@pytest.fixture(scope="module")
def sections():
    rng = random.Random(9)
    # One book holds most rows; one is a single row, one has no text, and one has no name.
    rows = [("long", k * 3, section(rng)) for k in range(50)]
    rows += [(b, k, section(rng)) for b in ("short", "other", None) for k in range(7)]
    rows += [("one", 5, "Prologue\n\n" + "\n\n".join(section(rng) for _ in range(9))), ("empty", 1, ""), ("empty", 2, None), ("tiny", 0, "Hi."), ("tiny", 1, "x")]
    rng.shuffle(rows)
    return rows


def whole(spark, rows):
    books = {}
    for book, no, text in sorted(rows, key=lambda r: r[1]):
        if text and text.strip():
            books.setdefault(book, []).append(text)
    return spark.createDataFrame([(b, "\n\n".join(t)) for b, t in books.items()], "book string, text string")


@pytest.mark.parametrize("block", [1024, 4])
def test_narration_of_many_rows_equals_one_row(spark, sections, block):
    rows = spark.createDataFrame(sections, "book string, no int, text string")
    sizes = {"max_chars": 120, "min_chars": 30, "min_chapter_length": 200}
    got = narrate_books(rows, ["book"], "no", block_rows=block, **sizes)
    one = whole(spark, sections).select("book", narration(F.col("text"), **sizes).alias("narration"))
    fields = ["book", "chunk_idx", "text", "para_idx", "chapter_no", "n_samples", "start_sample"]
    want = narration_chunks(one, ["book"]).select(*fields)
    got = sorted(map(repr, map(tuple, got.select(*fields).collect())))
    assert got == sorted(map(repr, map(tuple, want.collect())))
    assert len({r.split(",")[0] for r in got}) == 6


def test_chunks_of_many_rows_equal_one_row(spark, sections):
    # Every row is one paragraph at most, so that nothing is known beyond its lengths.
    rows = spark.createDataFrame(sections, "book string, no int, text string").filter("text <> ''")
    packed = rows.select("book", "no", packed_chunks(F.col("text"), 60).alias("chunks"))
    got = merged_across_rows(packed, ["book"], "no", 25, 60, block_rows=8)
    want = chunk_documents(whole(spark, sections), ["book"], max_chars=60, min_chars=25)
    columns = lambda df, no: sorted(repr((r["book"], r[no], r["text"])) for r in df.collect())
    assert columns(got, "chunk_no") == columns(want, "chunk_idx")


def test_chapters_of_a_table_of_contents(spark):
    rows = spark.createDataFrame([("b", k, f"Paragraph number {k} is here for good.") for k in range(6)], "book string, no int, text string")
    toc = spark.createDataFrame([("b", 0, 1), ("b", 80, 2)], "book string, start_char bigint, chapter_no int").withColumn("end_char", F.lit(None).cast("bigint"))
    got = narrate_books(rows, ["book"], "no", chapters=toc, min_chars=5).orderBy("chunk_idx").collect()
    assert [r["chapter_no"] for r in got] == [1, 1, 1, 2, 2, 2]
    assert [r["chapter_change"] for r in got] == [True, False, False, True, False, False]
    assert narrate_books(rows.limit(0), ["book"], "no").count() == 0
