import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from narrprep.operators import incremental as I
from narrprep.operators import jobs as J

KEY = "doc_id int, input_hash string, settings_hash string, chunk_idx int"


def chunk_table(spark, numbers, input_hash="h", settings="s"):
    return spark.createDataFrame([(1, input_hash, settings, i) for i in numbers], KEY)


def test_pending_and_reusable_make_all(spark):
    chunks, done = chunk_table(spark, range(6)), chunk_table(spark, [0, 2, 2])
    todo, kept = I.pending(chunks, done), I.reusable(chunks, done)
    assert sorted(r["chunk_idx"] for r in todo.collect()) == [1, 3, 4, 5]
    assert sorted(r["chunk_idx"] for r in kept.collect()) == [0, 2]
    assert I.pending(chunks, done.limit(0)).count() == 6
    # Another input or other settings make everything pending again.
    assert I.pending(chunks, chunk_table(spark, range(6), "other")).count() == 6
    assert I.pending(chunks, chunk_table(spark, range(6), "h", "other")).count() == 6


def test_recover_drops_missing_results(spark):
    got = I.recover(chunk_table(spark, range(5)), chunk_table(spark, [0, 1, 9]))
    assert sorted(r["chunk_idx"] for r in got.collect()) == [0, 1]


def test_run_progress(spark):
    chunks = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0)], "doc_id int, chunk_idx int")
    done = chunks.filter("doc_id = 1 and chunk_idx < 5")
    got = {r["doc_id"]: (r["completed_chunks"], r["total_chunks"], r["percent"]) for r in I.run_progress(chunks, done, ["doc_id"], "chunk_idx").collect()}
    assert got == {1: (5, 100, 5.0), 2: (0, 1, 0.0)}


def test_verify_tells_the_first_reason(spark):
    docs = spark.createDataFrame([(i, "h", "s") for i in range(1, 7)], "doc_id int, input_hash string, settings_hash string")
    runs = spark.createDataFrame(
        [(1, 1, "h", "s"), (2, 1, "x", "s"), (3, 1, "h", "x"), (4, 1, "x", "x"), (5, 2, "h", "s")],
        "doc_id int, version int, input_hash string, settings_hash string",
    )
    got = {r["doc_id"]: (r["valid"], r["reason"].split()[0]) for r in I.verify_runs(docs, runs).collect()}
    assert got == {1: (True, "stored"), 2: (False, "input"), 3: (False, "settings"), 4: (False, "input"), 5: (False, "stored"), 6: (False, "no")}
    bare = spark.createDataFrame([(1, 1, None, "s"), (2, None, "h", "s")], runs.schema)
    got = {r["doc_id"]: (r["valid"], r["reason"]) for r in I.verify_runs(docs.filter("doc_id < 3"), bare).collect()}
    assert got == {1: (False, "input differs from the stored run"), 2: (False, "stored run has another version")}
    known, other = I.readable_state(runs)
    assert (known.count(), other.count()) == (4, 1)


def test_commit_twice_keeps_one_copy(spark, tmp_path):
    path = str(tmp_path / "done")
    chunks = chunk_table(spark, range(20))
    I.commit_chunks(chunks, path, "a", buckets=4)
    I.commit_chunks(chunk_table(spark, [30]), path, "b", buckets=4)
    I.commit_chunks(chunks, path, "a", buckets=4)
    assert spark.read.parquet(path).count() == 21
    I.commit_chunks(chunk_table(spark, [1]), path, "a", buckets=4)
    assert spark.read.parquet(path).filter("run_id = 'a'").count() == 1
    I.commit_chunks(chunks, path, "a", buckets=4)
    assert I.drop_documents(spark.read.parquet(path), spark.createDataFrame([(1,)], "doc_id int")).count() == 0


T0 = dt.datetime(2024, 1, 1)
LOG = "job_id int, ts timestamp, event_id int, status string, stage string, percent double, chunk int, message string"


def log(spark, *rows):
    return spark.createDataFrame([(j, T0 + dt.timedelta(seconds=s), i, *state) for i, (j, s, *state) in enumerate(rows)], LOG)


@pytest.fixture
def history(spark):
    return log(
        spark,
        (1, 0, "pending", None, None, None, None),
        (1, 1, "processing", "extracting", 0.0, 0, "a"),
        (1, 1, "processing", "extracting", 0.0, 0, "a"),
        (1, 30, "processing", "chunking", 50.0, 4, "b"),
        (1, 31, "cancelled", "chunking", 50.0, 4, "b"),
        (1, 32, "completed", "finalizing", 90.0, 8, "c"),
        (2, 5, "pending", None, None, None, None),
    )


def test_current_view(history):
    got = {r["job_id"]: r for r in J.current_view(history).collect()}
    assert (got[1]["status"], got[1]["progress"]["percent"], got[1]["progress"]["chunk"]) == ("completed", 100.0, 8)
    assert (got[2]["status"], got[2]["progress"]["percent"], got[2]["progress"]["chunk"]) == ("pending", 0.0, 0)


def test_changes_skip_repeats(history):
    assert sorted(r["event_id"] for r in J.progress_changes(history).collect()) == [0, 1, 3, 4, 5, 6]
    # A null field that stays null is no change.
    assert [r["event_id"] for r in J.progress_changes(history, ["message"]).filter("job_id = 2").collect()] == [6]


def test_feed_ends_at_the_first_terminal_state(history):
    assert sorted(r["event_id"] for r in J.until_terminal(history).collect()) == [0, 1, 2, 3, 4, 6]


def test_stalls_and_violations(history):
    assert [(r["event_id"], r["gap_us"]) for r in J.stalled(history, 15).collect()] == [(2, 29_000_000)]
    assert [(r["from_status"], r["status"]) for r in J.illegal_transitions(history).collect()] == [("cancelled", "completed")]


def test_timings(history):
    got = {r["job_id"]: (r["wait_seconds"], r["run_seconds"]) for r in J.job_timings(history).collect()}
    assert got == {1: (1, 30), 2: (None, None)}


def test_pages(spark):
    jobs = spark.createDataFrame([(i, i % 2, T0 + dt.timedelta(hours=i // 4)) for i in range(20)], "job_id int, user_id int, created_at timestamp")
    page = [r["job_id"] for r in J.list_jobs(jobs, 0, limit=3, offset=1).collect()]
    assert page == [18, 12, 14]
    every = J.job_pages(jobs, limit=3, offset=1).filter("user_id = 0").orderBy("row_no").collect()
    assert [r["job_id"] for r in every] == page
    assert J.list_jobs(jobs, 0, limit=100).count() == 10
    with pytest.raises(ValueError):
        J.list_jobs(jobs, 0, limit=500)
    assert J.owned_job(jobs, 3, 0).count() == 0 and J.owned_job(jobs, 3, 1).count() == 1


def test_updates_are_refused_with_a_reason(spark):
    jobs = spark.createDataFrame([(1, "pending"), (2, "completed"), (3, "processing"), (4, "failed")], "job_id int, status string")
    updates = spark.createDataFrame([(1, "processing"), (2, "cancelled"), (3, "completed"), (4, "completed"), (5, "failed")], "job_id int, to_status string")
    got = {r["job_id"]: (r["status"], r["percent"], r["refused"]) for r in J.apply_updates(jobs, updates).collect()}
    assert got == {
        1: ("processing", None, None),
        2: ("completed", None, "too late to cancel, status completed"),
        3: ("completed", 100.0, None),
        4: ("failed", None, "Not allowed: failed>completed"),
        5: (None, None, "unknown job"),
    }


def test_update_logs_equal_a_loop(spark):
    rng = random.Random(4)
    names = [*J.STATUSES, "unheard of", None]
    # Half of all updates belong to one job; jobs 6 and null are not known.
    rows = [
        (rng.choice([0, 0, 0, 0, 1, 2, 3, 4, 5, 6, None]), T0 + dt.timedelta(seconds=rng.randrange(4000)), k, rng.choices(names, [3, 9, 1, 1, 1, 2, 1])[0])
        for k in range(1500)
    ]
    state = {0: "pending", 1: "processing", 2: "completed", 3: "pending", 4: "strange", 5: "pending", 9: "failed"}
    updates = spark.createDataFrame(rows, "job_id int, ts timestamp, event_id int, to_status string")
    current = spark.createDataFrame([*state.items(), (None, "pending")], "job_id int, status string")
    now = {k: v if v in J.STATUSES else None for k, v in state.items()}
    want = {}
    for job, _, k, to in sorted(rows, key=lambda r: (r[1], r[2])):
        before = now.get(job)
        after = to if (before, to) in J.TRANSITIONS else before
        want[k] = (before, after, 100.0 if before != after and after == "completed" else None, before == after or before is None)
        if job in now:
            now[job] = after
    for block, levels, fan in ((None, 1, 1024), (F.floor(F.unix_seconds("ts") / 50), 2, 4), (F.lit(0).cast("bigint"), 0, 2)):
        got = J.apply_update_log(current, updates, block=block, levels=levels, fan=fan).collect()
        assert {r["event_id"]: (r["from_status"], r["status"], r["percent"], r["refused"] is not None) for r in got} == want
        assert len(got) == len(rows)
    reasons = {r["refused"].split(":")[0].split(",")[0] for r in got if r["refused"]}
    assert reasons == {"unknown job", "Not allowed", "too late to cancel"}


def test_new_jobs_are_the_same_when_made_again(spark):
    requests = spark.createDataFrame([(7, "up/7/My Book.EPUB", T0, [1, 2]), (7, "up/7/b", T0, [])], "user_id int, upload_key string, created_at timestamp, chapters array<int>")
    a, b = J.new_jobs(requests).collect(), J.new_jobs(requests).collect()
    assert a == b and a[0]["job_id"] != a[1]["job_id"]
    assert [(r["input_filename"], r["input_format"], r["chapters_to_convert"], r["status"]) for r in a] == [
        ("My Book.EPUB", "epub", "[1,2]", "pending"), ("b", "", None, "pending"),
    ]


def test_requests(spark):
    df = spark.createDataFrame([(1, 0.5, "[1, 3]"), (2, 2.5, None), (3, None, "[]"), (4, 2.0, "bad")], "job_id int, speed double, chapters_to_convert string")
    ok, bad = J.split_requests(df)
    assert sorted(r["job_id"] for r in ok.collect()) == [1, 4] and sorted(r["job_id"] for r in bad.collect()) == [2, 3]
    assert [(r["job_id"], r["chapter_no"]) for r in J.requested_chapters(df, ["job_id"]).collect()] == [(1, 1), (1, 3)]
    assert J.pending_jobs(df.withColumn("status", F.lit("failed"))).count() == 0
