"""Streams give what the batch operators give, over several micro-batches and restarts."""

import datetime as dt
import functools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from narrprep.operators.chunks import chunk_documents
from narrprep.operators.jobs import open_stalls, progress_changes, stalled
from narrprep.operators.observe import ProgressListener
from narrprep.plans.oracle import ORACLE
from narrprep.plans.queries import QUERIES
from narrprep.streaming import feeds as D
from narrprep.streaming import prepare as P
from narrprep.streaming import progress as G

T0 = dt.datetime(2024, 1, 1)
LOG = "job_id int, ts timestamp, event_id int, status string, stage string"


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def events(spark, n=400, seed=1):
    """Half of all updates belong to one job."""
    rng = random.Random(seed)
    rows = [
        (0 if rng.random() < 0.5 else rng.randrange(1, 9), T0 + dt.timedelta(seconds=i * 10), i,
         rng.choice(["pending", "processing"]), rng.choice(["a", "b"]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, LOG)


@pytest.fixture
def feed(spark, tmp_path):
    """Folder of files that arrive in time order, and all their rows."""
    folder = tmp_path / "in"
    every = events(spark)
    for k in range(4):
        part = every.filter((F.col("event_id") >= k * 100) & (F.col("event_id") < (k + 1) * 100))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), every


def stream_of(spark, folder):
    # A time filter on file names is not needed: files arrive in write order.
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_prepared_stream_equals_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    prepare = lambda df: chunk_documents(df, ["doc_id"])
    target, state = str(tmp_path / "rows"), str(tmp_path / "state")
    P.run_to_end(P.start_prepared(stream, prepare, target, state))
    # A restart without new files adds nothing; a new file adds only its rows.
    P.run_to_end(P.start_prepared(stream, prepare, target, state))
    got = spark.read.parquet(target)
    assert got.select("batch_id").distinct().count() == 3
    assert same(got.drop("batch_id"), prepare(docs))
    more = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    P.run_to_end(P.start_prepared(stream, prepare, target, state))
    assert same(spark.read.parquet(target).drop("batch_id"), prepare(docs.unionByName(more)))


def test_change_feed_over_batches_equals_batch(spark, feed):
    folder, every = feed
    got = G.change_feed_table(spark, stream_of(spark, folder), "1 minute", ["status", "stage"])
    passed = T0 + dt.timedelta(seconds=3990 - 60)
    assert same(got, progress_changes(every, ["status", "stage"]).filter(F.col("ts") < F.lit(passed)))


@pytest.fixture
def disorder(spark, tmp_path):
    """Folder table of three files, none of them in time order, all spanning the whole time; and all rows."""
    table = tmp_path / "events.parquet"
    every = events(spark, 300, 5).withColumn("job_id", F.expr("nullif(job_id, 3)"))
    for k in (2, 0, 1):
        every.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(table))
    return P.file_stream(spark, str(tmp_path), "events", files_per_trigger=1), every, str(table)


def test_change_feed_in_disorder_equals_batch(spark, disorder):
    stream, every, table = disorder
    got = G.change_feed_table(spark, stream, "1 hour", ["status", "stage"])
    # Nothing of the last hour is sent before the watermark has passed it; the whole log is shorter.
    assert got.count() == 0
    later = every.limit(1).withColumn("ts", F.lit(T0 + dt.timedelta(days=1))).withColumn("event_id", F.lit(1000))
    later.withColumn("job_id", F.lit(77)).coalesce(1).write.mode("append").parquet(table)
    got = G.change_feed_table(spark, stream, "1 hour", ["status", "stage"])
    assert same(got, progress_changes(every, ["status", "stage"]))


@pytest.fixture
def mixed(spark, small, tmp_path, monkeypatch):
    """The events in six files that all span the whole log, one per micro-batch; folder and a connection to them."""
    path = tmp_path / "events.parquet"
    every = spark.read.parquet(f"{small}/events.parquet")
    for k in (5, 2, 0, 4, 1, 3):
        every.filter(F.col("event_id") % 6 == k).coalesce(1).write.mode("append").parquet(str(path))
    monkeypatch.setattr(P, "file_stream", functools.partial(P.file_stream, files_per_trigger=1))
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{path}/*.parquet'")
    return str(tmp_path), duck


def equals_sql(spark, mixed, name, sql):
    got, want = QUERIES[name](spark, mixed[0]).toPandas(), mixed[1].execute(ORACLE[sql]).df()
    assert len(got) > 0
    assert compare.canonical(got) == compare.canonical(want)


@pytest.mark.parametrize("name", ["stream_changes", "stream_done", "stream_silent"])
def test_registered_feeds_are_whole_over_mixed_files(spark, mixed, name):
    equals_sql(spark, mixed, name, name)


def test_feeds_of_files_in_order_have_no_late_rows(spark, feed):
    folder, every = feed
    told = D.feed_table(spark, stream_of(spark, folder), every, "1 minute", D.Changes(), ["status", "stage"])
    assert told.filter("kind = 'late'").count() == 0
    got = told.filter("kind = 'progress'").drop("kind", "micros")
    assert same(got, progress_changes(every, ["status", "stage"]))


def test_late_updates_reach_a_table_of_their_own(spark, disorder):
    stream, every, _ = disorder
    told = D.feed_table(spark, stream, every, "1 minute", D.Changes(), ["status", "stage"]).cache()
    late = told.filter("kind = 'late'")
    assert 0 < late.count() < every.count()
    # Taken in time order; nothing is in the feed and among the late ones.
    assert told.filter("kind = 'progress'").join(late, "event_id").count() == 0
    # A delay that covers the disorder leaves none.
    told = D.feed_table(spark, stream, every, "2 hours", D.Changes(), ["status", "stage"])
    assert told.filter("kind = 'late'").count() == 0
    assert same(told.filter("kind = 'progress'").drop("kind", "micros"), progress_changes(every, ["status", "stage"]))


def test_a_feed_ends_with_the_job(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), 0, "processing", "a"), (1, at(3), 1, "completed", "a"), (1, at(4), 2, "processing", "b"), (None, at(9), 3, "failed", "a"), (2, None, 4, "x", "a")]
    log = spark.createDataFrame(rows, LOG)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    told = D.feed_table(spark, stream_of(spark, str(tmp_path / "in")), log, "0 seconds", D.Changes(stop=True), ["status", "stage"])
    got = sorted((r["event_id"], r["kind"], r["micros"]) for r in told.collect())
    assert got == [(0, "progress", None), (1, "done", 3_000_000), (1, "progress", None), (3, "done", 0), (3, "progress", None)]


def test_silence_is_told_once_and_taken_back(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    # Job 1 falls silent and is heard again, job 2 ends, job 3 stays silent, job 4 is heard to the end.
    steps = [[(1, at(0), 0, "p", "a"), (2, at(0), 1, "completed", "a"), (3, at(1), 2, "p", "a")], [(4, at(100), 3, "p", "a")], [(4, at(110), 4, "p", "a")],
             [(1, at(120), 5, "p", "a"), (4, at(121), 6, "p", "a")]]
    import time

    for rows in steps:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    log = spark.createDataFrame([r for rows in steps for r in rows], LOG)
    told = D.feed_table(spark, stream_of(spark, str(tmp_path / "in")), log, "0 seconds", D.Stalls(15_000_000), ["status"])
    got = sorted((r["job_id"], r["kind"], r["event_id"]) for r in told.collect())
    assert got == [(1, "gap", 0), (1, "heard", 0), (1, "silent", 0), (3, "silent", 2)]


def test_stalls_equal_the_batch(spark, disorder):
    stream, every, _ = disorder
    got = D.stall_table(spark, stream, every, "1 minute", 40.0)
    gaps = stalled(every, 40.0).select(*every.columns, "next_ts", "gap_us")
    ends = open_stalls(every, 40.0, fields=every.columns)
    want = gaps.unionByName(ends.select(*every.columns, F.lit(None).cast("timestamp").alias("next_ts"), F.lit(None).cast("bigint").alias("gap_us")))
    assert got.count() > 0 and same(got, want)


def test_sessions_that_straddle_the_limit_are_open(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    # The first update of job 1 lies before the limit, its last one behind; job 2 ended before.
    rows = [(1, at(80), 0, "p", "a"), (1, at(88), 1, "p", "a"), (2, at(10), 2, "p", "a"), (3, at(100), 3, "p", "a")]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = P.quiet_table(spark, stream_of(spark, str(tmp_path / "in")), "0 seconds").collect()
    assert [(r["job_id"], r["n_updates"]) for r in got] == [(2, 1)]


def test_registered_sessions_are_whole_over_mixed_files(spark, mixed):
    equals_sql(spark, mixed, "stream_stalls", "stream_stalls")


def test_a_job_that_ended_is_sent_once(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), 0, "processing", "a"), (1, at(1), 1, "completed", "a"), (1, at(2), 2, "completed", "a"), (2, at(9), 3, "x", "a")]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = G.change_feed(stream_of(spark, str(tmp_path / "in")), "0 seconds", ["status", "stage"], forget_ms=1000)
    got = P.streamed_table(spark, feed, "test-ended").collect()
    assert sorted(r["event_id"] for r in got) == [0, 1]


def test_latest_state_over_batches(spark, feed):
    folder, every = feed
    got = G.latest_table(spark, stream_of(spark, folder), ["status", "stage", "event_id"])
    want = every.groupBy("job_id").agg(
        F.max_by(F.struct("status", "stage", "event_id"), "event_id").alias("s"), F.count("*").alias("n_updates")
    ).select("job_id", "s.*", "n_updates")
    assert same(got, want)


def test_repeats_are_dropped(spark, feed):
    folder, every = feed
    stream = stream_of(spark, folder)
    kept = P.without_repeats(stream.unionByName(stream), ["event_id"], delay="2 hours")
    assert same(P.streamed_table(spark, kept, "test-dedup"), every)


def test_sessions_end_at_a_gap(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), 0, "p", "a"), (1, at(10), 1, "p", "a"), (1, at(60), 2, "p", "a"), (2, at(500), 3, "p", "a")]
    spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = P.streamed_table(spark, P.quiet_sessions(stream_of(spark, str(tmp_path / "in")), "0 seconds"), "test-quiet").collect()
    # The last session is still open.
    assert sorted((r["job_id"], r["session_end"], r["n_updates"]) for r in got) == [(1, at(25), 2), (1, at(75), 1)]


def test_sessions_in_disorder_lose_nothing_within_the_delay(spark, disorder):
    stream, every, table = disorder
    every.limit(1).withColumn("ts", F.lit(T0 + dt.timedelta(days=1))).coalesce(1).write.mode("append").parquet(table)
    got = P.streamed_table(spark, P.quiet_sessions(stream, "2 hours", gap="20 seconds"), "test-disorder")
    assert got.agg(F.sum("n_updates")).first()[0] == every.count()


def test_latest_state_in_disorder(spark, disorder):
    stream, every, _ = disorder
    got = G.latest_table(spark, stream, ["status", "stage", "event_id"])
    want = every.groupBy("job_id").agg(
        F.max_by(F.struct("status", "stage", "event_id"), "event_id").alias("s"), F.count("*").alias("n_updates")
    ).select("job_id", "s.*", "n_updates")
    assert same(got, want)


def test_listener_sees_batches(spark, feed):
    seen = []
    listener = ProgressListener(seen.append)
    spark.streams.addListener(listener)
    try:
        P.streamed_table(spark, stream_of(spark, feed[0]), "test-listener")
        for _ in range(50):
            if any(e["stage"] == "ended" for e in seen):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(e.get("rows", 0) for e in seen) == 400


def test_a_stream_reads_a_folder_table_and_only_its_own(spark, tmp_path):
    from narrprep.streaming.prepare import file_stream, streamed_table

    folder = str(tmp_path)
    spark.range(100).repartition(3).write.parquet(f"{folder}/events.parquet")
    spark.range(7).write.parquet(f"{folder}/events_old.parquet")
    assert streamed_table(spark, file_stream(spark, folder, "events"), "stream-test").count() == 100
