"""Process only what is missing: fingerprints, validation, recovery, commits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import content_fingerprint

# Version of stored run state.
STATE_VERSION = 1

RUN_KEY = ["doc_id", "input_hash", "settings_hash"]
CHUNK_KEY = [*RUN_KEY, "chunk_idx"]


def pending(chunks: DataFrame, done: DataFrame, keys: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """Chunks that still have to be made; all of them when nothing is done."""
    return chunks.join(done.select(*keys).distinct(), list(keys), "left_anti")


#: Documents to go on with that may be broadcast to the texts, about 200 bytes each.
FEW_DOCUMENTS = 100_000


def input_manifest(documents: DataFrame, settings_hash: str, text: str = "text") -> DataFrame:
    """Hashes of every document as it is now; made once when documents arrive, and kept beside them."""
    return documents.select(
        "doc_id", content_fingerprint(F.col(text)).alias("input_hash"), F.lit(settings_hash).alias("settings_hash")
    )


def run_manifest(done: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per run: its key, the chunks it has (``total_chunks`` of ``totals``) and those that are done."""
    finished = done.select(*CHUNK_KEY).distinct().groupBy(*RUN_KEY).agg(F.count("chunk_idx").alias("done_chunks"))
    return totals.select(*RUN_KEY, "total_chunks").join(finished, RUN_KEY, "left").withColumn(
        "done_chunks", F.coalesce("done_chunks", F.lit(0).cast("bigint"))
    )


def unfinished(inputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents whose present run is not done, from the manifests alone.

    ``started`` says that some of its chunks are done.  Inputs and runs are held against each other by their run key,
    and where both are tables bucketed by ``doc_id`` without a shuffle.
    """
    known = runs.select(
        F.col("doc_id").alias("run_doc"), F.col("input_hash").alias("run_input"), F.col("settings_hash").alias("run_settings"),
        "done_chunks", "total_chunks",
    )
    same = (
        (F.col("doc_id") == F.col("run_doc"))
        & (F.col("input_hash") == F.col("run_input"))
        & (F.col("settings_hash") == F.col("run_settings"))
    )
    todo = inputs.select(*RUN_KEY).join(known, same, "left").filter(~F.coalesce(F.col("done_chunks") >= F.col("total_chunks"), F.lit(False)))
    return todo.select(*RUN_KEY, F.coalesce(F.col("done_chunks") > 0, F.lit(False)).alias("started"))


def resume_chunks(
    documents: DataFrame,
    inputs: DataFrame,
    runs: DataFrame,
    done: DataFrame,
    cut: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Chunks that still have to be made; texts of finished documents are not cut.

    ``inputs`` is the manifest of the documents, ``runs`` that of the runs (``run_manifest``), ``done`` the key of every
    finished chunk.  ``cut`` makes chunk rows (``doc_id``, ``chunk_idx``, …) out of documents.  Which documents go on is
    settled by keys; only their texts reach ``cut``, and only chunks of documents that were begun are held against
    ``done``.  Ids of documents must be unique and not null.
    """
    todo = unfinished(inputs, runs)
    rows = todo.count()
    todo = F.broadcast(todo) if rows <= FEW_DOCUMENTS else todo
    chunks = cut(documents.join(todo.select(F.col("doc_id").alias("todo_doc")), F.col("doc_id") == F.col("todo_doc"), "left_semi"))
    started = todo.filter("started").select(F.col("doc_id").alias("begun_doc"), "input_hash", "settings_hash")
    made = done.join(
        started.withColumnsRenamed({"input_hash": "begun_input", "settings_hash": "begun_settings"}),
        (F.col("doc_id") == F.col("begun_doc"))
        & (F.col("input_hash") == F.col("begun_input"))
        & (F.col("settings_hash") == F.col("begun_settings")),
        "left_semi",
    ).select(F.col("doc_id").alias("made_doc"), F.col("chunk_idx").alias("made_idx"))
    return chunks.join(made, (F.col("doc_id") == F.col("made_doc")) & (F.col("chunk_idx") == F.col("made_idx")), "left_anti")


def reusable(chunks: DataFrame, done: DataFrame, keys: Sequence[str] = CHUNK_KEY) -> DataFrame:
    return chunks.join(done.select(*keys).distinct(), list(keys), "left_semi")


def recover(done: DataFrame, stored: DataFrame, keys: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """Finished chunks whose stored result is still there."""
    return done.join(stored.select(*keys).distinct(), list(keys), "left_semi")


def readable_state(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run states of the known version, and the others."""
    known = F.col("version").eqNullSafe(F.lit(STATE_VERSION))
    return manifest.filter(known), manifest.filter(~known)


def verify_runs(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Whether the stored run of every document can go on, with the reason.

    ``documents`` holds ``doc_id, input_hash, settings_hash`` as they are now.
    """
    stored = manifest.select(
        "doc_id",
        F.lit(True).alias("stored"),
        F.col("version").alias("run_version"),
        F.col("input_hash").alias("run_input"),
        F.col("settings_hash").alias("run_settings"),
    )
    reason = (
        F.when(F.col("stored").isNull(), "no stored run")
        .when(~F.col("run_version").eqNullSafe(F.lit(STATE_VERSION)), "stored run has another version")
        .when(~F.col("run_input").eqNullSafe(F.col("input_hash")), "input differs from the stored run")
        .when(~F.col("run_settings").eqNullSafe(F.col("settings_hash")), "settings differ from the stored run")
        .otherwise("stored run can go on")
    )
    return (
        documents.select("doc_id", "input_hash", "settings_hash")
        .join(stored, "doc_id", "left")
        .select("doc_id", reason.alias("reason"), (reason == "stored run can go on").alias("valid"))
    )


def run_progress(chunks: DataFrame, done: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Finished and total parts and percent per run; 0 percent of nothing.

    Both sides are counted before they meet, so a run with very many parts is
    never one task.
    """
    total = chunks.groupBy(*keys).agg(F.count(part).alias("total_chunks"))
    finished = done.select(*keys, part).distinct().groupBy(*keys).agg(F.count(part).alias("completed_chunks"))
    completed = F.coalesce("completed_chunks", F.lit(0).cast("bigint"))
    return total.join(finished, list(keys), "left").select(
        *keys,
        completed.alias("completed_chunks"),
        "total_chunks",
        F.coalesce(F.try_divide(completed * F.lit(100.0), F.col("total_chunks")), F.lit(0.0)).alias("percent"),
    )


def bucket_of(key: str = "doc_id", buckets: int = 256):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def commit_chunks(chunks: DataFrame, path: str, run_id: str | int, key: str = "doc_id", buckets: int = 256) -> None:
    """Write finished chunks of one run; writing the same run again replaces all of it.

    The rebalance hint gathers a bucket's rows into few files and splits a
    bucket that holds far more rows than the others.
    """
    (
        chunks.withColumn("doc_bucket", bucket_of(key, buckets))
        .hint("rebalance", "doc_bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("doc_bucket")
        .parquet(f"{path.rstrip('/')}/run_id={run_id}")
    )


def drop_documents(done: DataFrame, restart: DataFrame) -> DataFrame:
    """State without the documents that are to start anew."""
    return done.join(restart.select("doc_id").distinct(), "doc_id", "left_anti")
