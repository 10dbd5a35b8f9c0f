"""Live job progress: change feed and latest state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import CHANGE_FIELDS, TERMINAL
from ..session import work_folder
from .prepare import run_to_end, streamed_table

ORDER = ("ts", "event_id")
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Last state sent, whether it ended the job, and the updates that wait for the watermark.
WAITING = "sent string, ended boolean, at array<bigint>, tie array<bigint>, now array<string>, done array<boolean>, whole array<string>"


def change_feed(
    stream: DataFrame,
    delay: str,
    fields: Sequence[str] = CHANGE_FIELDS,
    forget_ms: int | None = None,
) -> DataFrame:
    """Updates that differ from the one before of the same job, in event-time order.

    An update waits in the keyed state of its job until the watermark has passed it, so updates may arrive in any
    order within ``delay``; the state of a job holds its last state and the updates of that span.  Later ones are
    dropped by the engine, which counts them in the progress of the query (``numRowsDroppedByWatermark``).  Updates
    behind the last watermark are sent once it moves on; ``operators.jobs.progress_changes`` gives them for a table
    that is at rest.  With ``forget_ms`` a job is forgotten that long after the update that ended it.  Updates
    without a time are dropped; those without a job are one job.
    """
    ended = F.col("status").isin(TERMINAL) if "status" in stream.columns else F.lit(False)
    narrow = stream.withWatermark("ts", delay).select(
        "job_id",
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(-1)).alias("tie"),
        F.to_json(F.struct(*fields), JSON).alias("now"),
        F.coalesce(ended, F.lit(False)).alias("done"),
        F.to_json(F.struct(*stream.columns), JSON).alias("whole"),
    )

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, gone, *waiting = state.get if state.exists else (None, False, [], [], [], [], [])
        rows = list(zip(*waiting, strict=True))
        for frame in frames:
            rows.extend(frame[["at", "tie", "now", "done", "whole"]].itertuples(index=False, name=None))
        rows.sort(key=lambda r: r[:2])
        watermark = state.getCurrentWatermarkMs()
        ready = 0
        changes = []
        while ready < len(rows) and rows[ready][0] // 1000 < watermark:
            _, _, now, gone, whole = rows[ready]
            if now != sent:
                changes.append(whole)
            sent, ready = now, ready + 1
        left = rows[ready:]
        if state.hasTimedOut and gone and not ready and not left:
            state.remove()
        else:
            columns = [list(c) for c in zip(*left, strict=True)] if left else [[], [], [], [], []]
            kinds = (int, int, str, bool, str)
            state.update((sent, bool(gone), *[[k(v) for v in c] for k, c in zip(kinds, columns, strict=True)]))
            if left:
                state.setTimeoutTimestamp(max(left[0][0] // 1000, watermark + 1))
            elif gone and forget_ms is not None:
                state.setTimeoutTimestamp(watermark + 1 + forget_ms)
        yield pd.DataFrame({"whole": pd.Series(changes, dtype=object)})

    changed = narrow.groupBy("job_id").applyInPandasWithState(
        step, "whole string", WAITING, "append", GroupStateTimeout.EventTimeTimeout
    )
    return changed.select(F.from_json("whole", stream.schema, JSON).alias("r")).select("r.*")


def change_feed_table(
    spark: SparkSession, stream: DataFrame, delay: str, fields: Sequence[str] = CHANGE_FIELDS
) -> DataFrame:
    """Changes up to the last watermark of everything that is there now, as a table."""
    return streamed_table(spark, change_feed(stream, delay, fields), "changes")


def latest_stream(stream: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Latest state of every job as a streaming aggregate (update mode)."""
    return (
        stream.groupBy("job_id")
        .agg(F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("s"), F.count(F.lit(1)).alias("n_updates"))
        .select("job_id", *[F.col(f"s.{f}").alias(f) for f in fields], "n_updates")
    )


def latest_table(spark: SparkSession, stream: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Latest state after everything that is there now.

    Updates go to a table by batch id; the newest row of a job is its state.
    """
    folder = work_folder(spark, "latest")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("seen", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{folder}/rows/batch_id={batch_id}"
        )

    query = (
        latest_stream(stream, fields)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run_to_end(query)
    updates = spark.read.parquet(f"{folder}/rows").drop("batch_id")
    columns = [c for c in updates.columns if c not in ("job_id", "seen")]
    return updates.groupBy("job_id").agg(F.max_by(F.struct(*columns), F.col("seen")).alias("s")).select(
        "job_id", "s.*"
    )
