import hashlib
import os

import pytest
from pyspark.sql import functions as F

from narrprep.operators import voices as V
from narrprep.operators.observe import observed
from narrprep.operators.scoring import paced_model, score_chunks
from narrprep.operators.timeline import with_durations
from narrprep.session import stage
from narrprep.sources import files as S
from narrprep.sources import sinks as K
from narrprep.sources.tables import spread, with_metadata

RULER = "=" * 60


@pytest.mark.parametrize("path, fmt", [("o.wav", "wav"), ("o.WAV", "wav"), ("o.mp3", "mp3"), ("o.m4b", "m4b"), ("o.m4a", "m4b"), ("o.aac", "m4b"), ("o.ogg", None), ("o", None)])
def test_output_formats(spark, path, fmt):
    df = spark.createDataFrame([(path,)], "path string")
    assert S.with_format(df, direction="output").first()["format"] == fmt


def test_unknown_inputs_are_set_aside(spark):
    df = spark.createDataFrame([("a.pdf",), ("b.EPUB",), ("c.doc",), ("d",)], "path string")
    ok, bad = S.route_files(df)
    assert [(r["format"], r["media_type"]) for r in ok.collect()] == [("pdf", "application/pdf"), ("epub", "application/epub+zip")]
    assert [r["reason"] for r in bad.collect()] == ["no reader for .doc", "no reader for unknown"]


def test_manifest_and_text_files(spark, tmp_path):
    body = "Body\nTEXT again"
    (tmp_path / "a.txt").write_text(f"{RULER}\nTEXT\n{RULER}\n\n{body}\n")
    (tmp_path / "b.txt").write_text("plain")
    got = {os.path.basename(r["path"]): r["text"] for r in S.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": body, "b.txt": "plain"}
    manifest = {os.path.basename(r["path"]): r for r in S.file_manifest(spark, str(tmp_path), "*.txt").collect()}
    assert manifest["b.txt"]["input_hash"] == hashlib.sha256(b"plain").hexdigest() and manifest["b.txt"]["length"] == 5


def exported(spark):
    df = spark.createDataFrame([(1, "Body", ["1. One (page 3)", "2. Two"]), (2, "Other", [])], "doc_id int, text string, listing array<string>")
    meta = F.struct(F.lit("T").alias("title"), F.lit("").alias("author"), F.lit("").alias("subject"), F.lit("").alias("creator"), F.lit("P").alias("producer"), F.lit(3).alias("page_count"))
    return df.withColumn("metadata", meta).select("doc_id", K.export_text("metadata", "listing", "text").alias("export"))


def test_export_layout(spark):
    rows = {r["doc_id"]: r["export"] for r in exported(spark).collect()}
    head = f"{RULER}\nMETADATA\n{RULER}\ntitle: T\nproducer: P\npage_count: 3\n\n"
    assert rows[1] == head + f"{RULER}\nCHAPTERS\n{RULER}\n1. One (page 3)\n2. Two\n\n{RULER}\nTEXT\n{RULER}\n\nBody"
    assert rows[2] == head + f"{RULER}\nTEXT\n{RULER}\n\nOther"


def test_written_text_reads_back(spark, tmp_path):
    path = str(tmp_path / "out")
    K.write_text(exported(spark), path, buckets=2)
    back = spark.read.option("lineSep", "\f").text(path)
    assert sorted(r["value"] for r in back.select("value").collect()) == sorted(r["export"] for r in exported(spark).collect())


def test_chapter_listing(spark):
    df = spark.createDataFrame([(1, 1, "One", 3), (1, 2, "Two", 0), (1, 3, "Three", None)], "doc_id int, chapter_no int, title string, start_section int")
    rows = K.chapter_listing(df, ["doc_id"]).orderBy("chapter_no").collect()
    assert [(r["start"], r["line"]) for r in rows] == [("3", "1. One (page 3)"), ("?", "2. Two"), ("?", "3. Three")]


def test_chunk_sink_replaces_only_its_documents(spark, tmp_path):
    path = str(tmp_path / "chunks")
    df = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id int, chunk_idx int")
    K.write_chunks(df, path, buckets=8)
    K.write_chunks(df.filter("doc_id = 3"), path, buckets=8)
    left = spark.read.parquet(path)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(50))
    K.write_chunks(df.filter("doc_id = 3").withColumn("chunk_idx", F.lit(7)), path, buckets=8)
    left = spark.read.parquet(path)
    assert left.count() == 50 and left.filter("doc_id = 3").first()["chunk_idx"] == 7


def test_stage_reads_back(spark):
    df = spark.range(5).withColumn("t", F.lit("x"))
    assert stage(df, "test-stage").exceptAll(df).count() == 0


def test_metadata(spark):
    html = '<head><title>A &amp; B</title><meta name="author" content="C"></head>'
    row = with_metadata(spark.createDataFrame([(html,)], "html string")).first()["metadata"]
    assert (row["title"], row["author"], row["subject"], row["page_count"]) == ("A & B", "C", "", 1)


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 1000, 1, 64)
    assert spread(wide) is wide
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 16


def test_voices(spark):
    assert V.list_voices(spark).count() == 22
    assert [r["voice"] for r in V.list_voices(spark, "e").collect()] == ["ef_dora", "em_alex"]
    rows = spark.createDataFrame([("af_heart",), ("ff_new",), ("xx",), ("",), ("hf_x",)], "voice string")
    got = {r["voice"]: (r["lang_code"], r["lang_name"]) for r in V.route_voices(rows).collect()}
    assert got == {
        "af_heart": ("a", "American English"), "ff_new": ("f", "French"), "xx": ("a", "American English"),
        "": ("a", "American English"), "hf_x": ("a", "American English"),
    }
    groups = {r["lang_code"]: r["voices"] for r in V.voices_by_language(V.voice_table(spark)).collect()}
    assert groups["z"] == ["zf_xiaobei", "zm_yunjian"] and len(groups["a"]) == 9


def test_scoring_equals_the_estimate(spark):
    texts = [(i, "word " * i, v, 1.0 + i % 3) for i in range(200) for v in ("af_heart", "ef_dora")]
    df = spark.createDataFrame(texts, "id int, text string, voice string, speed double").repartition(4)
    made = score_chunks(df, paced_model)
    plain = with_durations(df, speed=F.col("speed")).drop("n_words").filter("id > 0")
    assert made.exceptAll(plain.select(made.columns)).count() == 0 and made.count() == plain.count()


def test_observer_counts_while_writing(spark):
    df, watch = observed(spark.range(10), "n", total=F.sum("id"))
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 10, "total": 45}


def test_metadata_attributes_in_any_order_and_quotes(spark):
    html = """<meta content="Flann O'Brien" name="author"><meta data-x='1' name='description' content='a "b"'>"""
    row = with_metadata(spark.createDataFrame([(html,)], "html string")).first()["metadata"]
    assert (row["author"], row["subject"]) == ("Flann O'Brien", 'a "b"')


@pytest.mark.parametrize("html, text", [
    ("a&#1114112;b", "a\ufffdb"), ("&#128;", "\u20ac"), ("&#xD800;", "\ufffd"), ("&#65;&#x00042;", "AB"),
    ("&#9999999;", "\ufffd"), ('<a title="x>y">z</a>', "z"), ("<p class=a'b>z</p>", "z"),
])
def test_html_that_is_not_well_formed(one, html, text):
    from narrprep.functions.html import html_to_text

    assert one(html_to_text, html) == text
