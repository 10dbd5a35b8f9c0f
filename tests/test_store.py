"""Append-only store, and resuming from manifests."""

import os

import pytest
from pyspark.sql import functions as F

from narrprep.operators import incremental as I
from narrprep.sources import store as S


def rows_of(spark, docs, mark):
    return spark.createDataFrame([(d, k, f"{mark}{d}.{k}") for d in docs for k in range(3)], "doc_id int, chunk_idx int, text string")


def files(path):
    return {os.path.join(f, n): os.path.getmtime(os.path.join(f, n)) for f, _, names in os.walk(path) for n in names}


def held(spark, path):
    return {(r["doc_id"], r["chunk_idx"]): r["text"] for r in S.read_store(spark, path).collect()}


def test_the_newest_run_of_a_document_counts(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        S.read_store(spark, path)
    first = rows_of(spark, [*range(100), None], "a")
    S.append_run(first, path)
    before = files(path)
    S.append_run(rows_of(spark, [5, None], "b").filter("chunk_idx < 2"), path)
    # An increment touches nothing that is stored.
    assert {k: v for k, v in files(path).items() if k in before} == before
    want = {(d, k): f"a{d}.{k}" for d in [*range(100), None] for k in range(3) if d not in (5, None)}
    want |= {(d, k): f"b{d}.{k}" for d in (5, None) for k in range(2)}
    assert held(spark, path) == want
    only = S.read_store(spark, path, where=F.col("doc_id") < 6).collect()
    assert len(only) == 17
    # A document without rows is stored as such.
    S.append_run(rows_of(spark, [], "c"), path, documents=spark.createDataFrame([(7,)], "doc_id int"))
    want = {k: v for k, v in want.items() if k[0] != 7}
    assert held(spark, path) == want
    name = S.compact(spark, path)
    assert held(spark, path) == want and "c-" in name and S.compact(spark, path) is None
    S.append_run(rows_of(spark, [7], "d"), path)
    want |= {(7, k): f"d7.{k}" for k in range(3)}
    assert held(spark, path) == want
    assert len(S.drop_replaced(spark, path)) == 3
    assert held(spark, path) == want
    assert [r["n_rows"] for r in S.stored_documents(spark, path).filter("doc_id = 7").collect()] == [3]


def test_a_killed_write_leaves_the_former_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    S.append_run(rows_of(spark, range(10), "a"), path)
    want = held(spark, path)

    def killed(rows, folder, name, key, documents):
        rows.write.parquet(f"{folder}/{name}/data")
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(S, "_write", killed)
        with pytest.raises(RuntimeError):
            S.append_run(rows_of(spark, range(20), "b"), path)
    assert held(spark, path) == want
    S.append_run(rows_of(spark, [3], "c"), path)
    want |= {(3, k): f"c3.{k}" for k in range(3)}
    assert held(spark, path) == want
    # The open run might still be written, so what lies behind it is not gathered.
    assert S.compact(spark, path) is None
    (name,) = [n for n, done in S._folders(spark, path).items() if not done]
    with pytest.raises(ValueError):
        S.discard(spark, path, "run=000000000001r-" + "0" * 32)
    S.discard(spark, path, name)
    assert S.compact(spark, path) and held(spark, path) == want


def test_columns_may_be_added(spark, tmp_path):
    path = str(tmp_path / "store")
    S.append_run(rows_of(spark, [1], "a"), path)
    S.append_run(rows_of(spark, [2], "b").withColumn("voice", F.lit("v")), path)
    assert {(r["doc_id"], r["voice"]) for r in S.read_store(spark, path).collect()} == {(1, None), (2, "v")}


def test_finished_documents_are_not_cut(spark):
    docs = spark.createDataFrame([(d, f"t{d} " * 4) for d in range(12)], "doc_id int, text string")
    inputs = I.input_manifest(docs, "s")
    seen = spark.sparkContext.accumulator(0)

    def cut(rows):
        count = F.udf(lambda t: seen.add(1) or t.split(), "array<string>")
        return rows.select("doc_id", F.posexplode(count("text")).alias("chunk_idx", "text"))

    every = docs.select("doc_id", F.posexplode(F.split(F.trim("text"), " ")).alias("chunk_idx", "text"))
    keyed = inputs.join(every, "doc_id")
    # 0 to 5 are done, 6 and 7 in part, 8 with other settings, 9 with another input, the rest not at all.
    done = keyed.filter("doc_id < 6 or doc_id in (6, 7) and chunk_idx < 2 or doc_id in (8, 9)").select(*I.CHUNK_KEY)
    done = done.withColumns({
        "settings_hash": F.when(F.col("doc_id") == 8, "old").otherwise(F.col("settings_hash")),
        "input_hash": F.when(F.col("doc_id") == 9, "old").otherwise(F.col("input_hash")),
    })
    runs = I.run_manifest(done, keyed.groupBy(*I.RUN_KEY).agg(F.count("chunk_idx").alias("total_chunks")))
    got = {(r["doc_id"], r["chunk_idx"]) for r in I.resume_chunks(docs, inputs, runs, done, cut).collect()}
    assert got == {(d, k) for d in range(6, 12) for k in range(4) if not (d < 8 and k < 2)}
    assert seen.value == 6
    todo = {r["doc_id"]: r["started"] for r in I.unfinished(inputs, runs).collect()}
    assert todo == {d: d < 8 for d in range(6, 12)}
    # Without any run everything is to do.
    assert I.resume_chunks(docs, inputs, runs.limit(0), done.limit(0), cut).count() == 48
