"""Streams that reuse the batch operators on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import work_folder


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream over the parquet files of one table, which is a file or a folder of part files.

    The path is written as a pattern that only the table's own name matches, since a stream takes a plain path for
    a folder.
    """
    path = f"{folder.rstrip('/')}/{name}.parque"
    schema = spark.read.parquet(f"{path}t").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}[t]")


def start_prepared(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    target: str,
    state: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run a batch operator on every micro-batch and keep its rows.

    A document is whole inside one micro-batch.  Every batch writes its own
    ``batch_id`` folder, so a batch that is run again replaces its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def prepared_table(
    spark: SparkSession, stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], label: str
) -> DataFrame:
    """Everything that is there now, prepared as a stream, as a table."""
    folder = work_folder(spark, label)
    target, state = f"{folder}/rows", f"{folder}/state"
    run_to_end(start_prepared(stream, prepare, target, state))
    return spark.read.parquet(target).drop("batch_id")


def streamed_table(
    spark: SparkSession, stream: DataFrame, label: str, output_mode: str = "append"
) -> DataFrame:
    """Everything that is there now, through a plain append stream, as a table."""
    folder = work_folder(spark, label)
    target = f"{folder}/rows"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", target)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run_to_end(query)
    return spark.read.schema(stream.schema).parquet(target)


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a finished chunk that arrive within ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def quiet_sessions(
    stream: DataFrame, delay: str, key: str = "job_id", ts: str = "ts", gap: str = "15 seconds", last: str | None = None
) -> DataFrame:
    """Runs of updates of a job without a gap longer than ``gap``; each end is a stall.

    Updates may arrive out of order within ``delay``; the engine drops and counts later ones.  A session is sent
    once the watermark has passed its end; ``operators.jobs.open_stalls`` finds the jobs that fell silent for good.

    Sessions are merged in every task before the shuffle, so that a job with
    very many updates arrives as a few sessions; this is a setting of the session.  ``last`` names a column for the
    newest update of a session: filter by it in a batch, not by ``session_end``, which the optimizer would apply to
    single updates.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n_updates"), *([F.max(ts).alias(last)] if last else []))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_updates", *([last] if last else []))
    )


def quiet_table(
    spark: SparkSession, stream: DataFrame, delay: str, key: str = "job_id", ts: str = "ts", gap: str = "15 seconds"
) -> DataFrame:
    """Sessions of everything that is there now that ended ``delay`` before the last update, as a table.

    Updates are kept as they arrive and merged when all are there, so no order of the files loses any.
    """
    rows = streamed_table(spark, stream, "arrivals")
    limit = rows.agg(F.max(ts) - F.expr(f"interval {delay}") - F.expr(f"interval {gap}")).scalar()
    # The end of a session is a grouping column, and a condition on it would be moved below the merge, to single updates.
    sessions = quiet_sessions(rows, delay, key, ts, gap, last="last_update")
    return sessions.filter(F.col("last_update") < limit).drop("last_update")
