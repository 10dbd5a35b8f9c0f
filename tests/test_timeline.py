import random

import pytest
from pyspark.sql import functions as F

from narrprep.operators import scan
from narrprep.operators import timeline as L
from narrprep.operators.scan import number_block
from narrprep.session import stage
from narrprep.plans.narrate import narrate, narration_chunks, narration_markers, narration_summary


def py_timeline(chunks):
    """(chapter, samples, break) -> rows and markers, one by one."""
    at, known, rows, marks = 0, None, [], []
    for chapter, n, pause in chunks:
        marker, change = at, False
        if chapter is not None and chapter != known:
            change = True
            marks.append((chapter, at))
            if known is not None:
                at += 36_000
            known = chapter
        rows.append((marker, at, change))
        at += n + (12_000 if pause else 0)
    return rows, marks, at


@pytest.mark.parametrize("block", [3, 1000])
def test_timeline_equals_a_loop(spark, block):
    rng = random.Random(block)
    books = {b: [(rng.choice([None, 1, 2, 3]), rng.randrange(1, 99_999), rng.random() < 0.3) for _ in range(n)] for b, n in [("hot", 150), ("a", 1), ("b", 40)]}
    rows = [(b, i, c, n, p) for b, chunks in books.items() for i, (c, n, p) in enumerate(chunks)]
    df = spark.createDataFrame(rows, "book string, chunk_idx int, chapter_no int, n_samples long, paragraph_break_after boolean")
    lines = L.timeline(df, ["book"], ["chunk_idx"], number_block("chunk_idx", block))
    marks = L.chapter_markers(lines, ["book"], ["chunk_idx"], number_block("chunk_idx", block))
    got = {(r["book"], r["chunk_idx"]): r for r in lines.collect()}
    got_marks = {}
    for r in marks.orderBy("book", "marker_no").collect():
        got_marks.setdefault(r["book"], []).append(r)
    totals = {r["book"]: r for r in L.book_totals(lines, ["book"]).collect()}
    for book, chunks in books.items():
        want, want_marks, total = py_timeline(chunks)
        for i, (marker, start, change) in enumerate(want):
            r = got[book, i]
            assert (r["marker_sample"], r["start_sample"], r["chapter_change"], r["total_samples"]) == (marker, start, change, total)
            assert r["percent"] == pytest.approx(i / len(chunks) * 100)
        assert [(r["chapter_no"], r["start_sample"]) for r in got_marks.get(book, [])] == want_marks
        ends = [at for _, at in want_marks[1:]] + [total]
        assert [r["end_sample"] for r in got_marks.get(book, [])] == ends[: len(want_marks)]
        assert totals[book]["total_samples"] == total and totals[book]["n_chunks"] == len(chunks)


def test_tasks_sort_no_more_rows_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", 1000, raising=False)
    for n in (10_000, 40_000):
        df = spark.range(n).select(
            (F.col("id") % 3).cast("string").alias("book"), F.col("id").alias("chunk_idx"), (F.col("id") / 50).cast("int").alias("chapter_no"),
            F.lit(1000).cast("bigint").alias("n_samples"), F.lit(False).alias("paragraph_break_after"),
        )
        chunks = stage(df, "test-chunks")
        lines = L.timeline(chunks, ["book"], ["chunk_idx"], number_block("chunk_idx", 20))
        marks = L.chapter_markers(stage(lines, "test-lines"), ["book"], ["chunk_idx"], number_block("chunk_idx", 20), n_rows=n)
        for found in (lines, marks):
            tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
            assert max(tasks) < 2000
        assert sum(r["total_samples"] for r in lines.select("book", "total_samples").distinct().collect()) == lines.selectExpr("sum(n_samples + chapter_pause)").first()[0]


def test_marker_milliseconds_are_cut_off(spark):
    df = spark.createDataFrame([("b", 0, 1, 48_017, False), ("b", 1, 2, 24_000, False)], "book string, chunk_idx int, chapter_no int, n_samples long, paragraph_break_after boolean")
    lines = L.timeline(df, ["book"], ["chunk_idx"])
    rows = L.chapter_markers(lines, ["book"], ["chunk_idx"]).orderBy("marker_no").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in rows] == [(0, 2000), (2000, 4500)]


def test_metadata_text_in_blocks(spark):
    marks = spark.createDataFrame([("b", i, f"T{i}", i * 10, i * 10 + 10) for i in range(1, 4)], "book string, marker_no int, title string, start_ms long, end_ms long")
    parts = L.marker_metadata(marks, ["book"], block_markers=2).orderBy("block_no").collect()
    entry = "\n[CHAPTER]\nTIMEBASE=1/1000\nSTART={}\nEND={}\ntitle={}\n"
    want = ";FFMETADATA1\n" + "".join(entry.format(i * 10, i * 10 + 10, f"T{i}") for i in range(1, 4))
    assert len(parts) == 2 and "".join(r["metadata"] for r in parts) == want


def test_proportional_markers(spark):
    chapters = spark.createDataFrame([("b", 1, 0), ("b", 2, 50), ("b", 3, 0), ("b", 4, 500)], "book string, chapter_no int, start_char long")
    totals = spark.createDataFrame([("b", 100, 2400)], "book string, total_chars long, total_samples long")
    rows = L.proportional_markers(chapters, totals, ["book"], 2).orderBy("chapter_no").collect()
    assert [r["start_sample"] for r in rows] == [0, 1200, 1200, 2400]


def test_narration_in_the_row_equals_the_long_form(spark, small):
    text = F.concat(F.lit("Before the first chapter there is a sentence of more than fifty characters.\n\nChapter 1\n\n"), "text", F.lit("\n\nChapter 2: Two\n\n"), "text", F.lit("\n\nOne. Two."))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", text.alias("text"))
    told = stage(narrate(docs), "test-narration")
    chunks = narration_chunks(told)
    plain = told.select("doc_id", F.posexplode("narration.chunks").alias("chunk_idx", "c")).select(
        "doc_id", "chunk_idx", F.col("c.chapter_no").alias("chapter_no"), F.col("c.n_samples").alias("n_samples"),
        (F.col("c.end_sample") - F.col("c.start_sample") > F.col("c.n_samples")).alias("paragraph_break_after"),
    )
    lines = L.timeline(plain, ["doc_id"], ["chunk_idx"], number_block("chunk_idx", 8))
    a = chunks.select("doc_id", "chunk_idx", "start_sample")
    b = lines.select("doc_id", "chunk_idx", "start_sample")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    marks = L.chapter_markers(lines, ["doc_id"], ["chunk_idx"], number_block("chunk_idx", 8))
    c = narration_markers(told).select("doc_id", "marker_no", "chapter_no", "start_ms", "end_ms")
    d = marks.select("doc_id", "marker_no", "chapter_no", "start_ms", "end_ms")
    assert c.exceptAll(d).count() == 0 and d.exceptAll(c).count() == 0
    # Chunks before the first heading belong to no chapter.
    assert chunks.filter("chunk_idx = 0 and chapter_no is null").count() == docs.count()
    total = narration_summary(told).selectExpr("sum(total_samples)").first()[0]
    assert total == lines.select("doc_id", "total_samples").distinct().selectExpr("sum(total_samples)").first()[0]


def test_drift_option_finds_chapters_in_the_raw_text(spark):
    # Removing the ruler lines moves the cleaned text against the raw offsets.
    raw = "Intro.\n\n" + "-----\n" * 40 + "\n\nChapter 1\n\n" + "Some words here. " * 40
    df = spark.createDataFrame([(1, raw)], "doc_id int, text string")
    exact = narration_chunks(narrate(df)).filter("chapter_no = 1").count()
    drift = narration_chunks(narrate(df, drift=True)).filter("chapter_no = 1").count()
    assert drift < exact


def test_empty_documents_have_no_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, "  \n")], "doc_id int, text string")
    told = narrate(df)
    assert narration_chunks(told).count() == 0
    assert [(r["n_chunks"], r["total_samples"], r["duration"]) for r in narration_summary(told).collect()] == [(0, 0, "00:00:00")] * 2


def test_short_document_end_to_end(spark):
    df = spark.createDataFrame([(1, "This is a test sentence. And another one.")], "doc_id int, text string")
    row = narration_summary(narrate(df)).first()
    assert row["n_chunks"] == 1 and row["total_samples"] == 76_800
