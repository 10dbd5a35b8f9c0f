"""Live feeds on keyed state: changes and ends of jobs, and jobs that fell silent.

Updates of a job wait in its state until the watermark has passed them and are then taken in time order, so files may
come in any order within ``delay``.  Timers on event time take what waits when a job itself sends nothing more.  An
update that comes when a later one of its job has been taken already is not dropped: it leaves the feed as a row of kind
``late``, which the sink writes to a table of its own.

The engine itself drops what its watermark has passed.  Its watermark therefore stays behind the one that updates wait
for: it allows for ``keep``, the longest that an update may be late at all, and the feed adds the difference.

``change_table`` and ``stall_table`` run a feed over everything that is there now.  The watermark of such a run stops
``delay`` before the newest update; a second run from the same checkpoint, in which only the clock moves on, takes what
still waited.  Jobs with late rows, and no others, are told anew from the table at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.jobs import CHANGE_FIELDS, TERMINAL, job_ends, open_stalls, progress_changes, stalled
from ..session import work_folder
from .prepare import run_to_end

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: An update as it waits: time and tie-breaker, the state it tells, whether it ends the job, and the whole row.
UPDATE = "at bigint, tie bigint, now string, ends boolean, whole string"
FIELDS = ["at", "tie", "now", "ends", "whole"]
#: A row that closes a run: it moves the clock and is no update.
CLOSING = "closing"


class InOrder(StatefulProcessor):
    """Takes the updates of a job in time order once the watermark has passed them.

    ``last`` holds what is known of the job: a tuple that begins with time and tie-breaker of the last update taken.
    """

    last_schema = "at bigint, tie bigint"
    #: Milliseconds by which the time that updates wait for is ahead of the engine's watermark.
    ahead = 0

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", UPDATE)
        self.last = handle.getValueState("last", self.last_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        fresh, out = [], []
        for frame in rows:
            for row in frame[FIELDS].itertuples(index=False, name=None):
                row = (int(row[0]), int(row[1]), row[2], bool(row[3]), row[4])
                if known is not None and row[:2] <= tuple(known[:2]):
                    out.append(self.row("late", row))
                else:
                    fresh.append(row)
        yield from self._go_on(known, fresh, out, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        yield from self._go_on(known, [], [], timerValues)

    def _go_on(self, known, fresh: list, out: list, timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs()
        # Before the first watermark nothing is taken.
        watermark = passed + self.ahead if passed > 0 else 0
        waiting = sorted([*(tuple(r) for r in self.waiting.get()), *fresh]) if self.waiting.exists() else sorted(fresh)
        ready = [r for r in waiting if r[0] // 1000 < watermark]
        left = waiting[len(ready) :]
        before = known
        for row in ready:
            known = self.take(known, row, out)
        known, wake = self.rest(known, left, watermark, out)
        if ready or fresh:
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if known is None:
            self.last.clear()
        elif known != before:
            self.last.update(known)
        times = [left[0][0] // 1000 + 1] if left else []
        for time in [*times, *wake]:
            self.handle.registerTimer(max(time - self.ahead, passed + 1))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass

    def row(self, kind: str, update: tuple) -> tuple:
        raise NotImplementedError

    def take(self, known, update: tuple, out: list):
        """What is known of the job after ``update``; rows of the feed go to ``out``."""
        raise NotImplementedError

    def rest(self, known, left: list, watermark: int, out: list):
        """What is known when nothing more can be taken now, and times (ms) at which to look again."""
        return known, []


class Changes(InOrder):
    """Rows of kind ``progress`` where the state of a job changes, and one of kind ``done`` where it first ends.

    With ``stop`` nothing follows ``done``.  With ``forget_ms`` a job is forgotten that long after its end.
    """

    last_schema = "at bigint, tie bigint, now string, ended boolean, first bigint"
    columns = ["kind", "whole", "micros"]
    schema = "kind string, whole string, micros bigint"

    def __init__(self, stop: bool = False, forget_ms: int | None = None):
        self.stop, self.forget_ms = stop, forget_ms

    def row(self, kind, update, micros=None):
        return (kind, update[4], micros)

    def take(self, known, update, out):
        at, tie, now, ends, _ = update
        sent, ended, first = (known[2], known[3], known[4]) if known else (None, False, at)
        if now != sent and not (ended and self.stop):
            out.append(self.row("progress", update))
        if ends and not ended:
            out.append(self.row("done", update, at - first))
        return (at, tie, now, bool(ended or ends), first)

    def rest(self, known, left, watermark, out):
        if known is None or not known[3] or self.forget_ms is None or left:
            return known, []
        gone = known[0] // 1000 + self.forget_ms
        return (None, []) if watermark > gone else (known, [gone + 1])


class Stalls(InOrder):
    """Rows of kind ``gap`` where a job sent nothing for longer than ``micros`` between two updates, and one of kind
    ``silent`` where the clock has moved on that far and no update came; the next update takes it back (``heard``)."""

    last_schema = "at bigint, tie bigint, ends boolean, whole string, told boolean"
    columns = ["kind", "whole", "next_at", "micros"]
    schema = "kind string, whole string, next_at bigint, micros bigint"

    def __init__(self, micros: int):
        self.micros = micros

    def row(self, kind, update, next_at=None, micros=None):
        return (kind, update[4], next_at, micros)

    def take(self, known, update, out):
        at, tie, _, ends, whole = update
        if known and known[4]:
            out.append(("heard", known[3], at, None))
        if known and at - known[0] > self.micros:
            out.append(("gap", known[3], at, at - known[0]))
        return (at, tie, ends, whole, False)

    def rest(self, known, left, watermark, out):
        if known is None or known[2] or known[4] or left:
            return known, []
        if watermark * 1000 > known[0] + self.micros:
            out.append(("silent", known[3], None, None))
            return (*known[:4], True), []
        return known, [(known[0] + self.micros) // 1000 + 1]


def _millis(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_millis(F.expr(f"timestamp_millis(0) + interval {interval}"))).first()[0]


def feed(
    stream: DataFrame, delay: str, processor: InOrder, fields: Sequence[str] = CHANGE_FIELDS, keep: str = "30 days"
) -> DataFrame:
    """Rows of a live feed: ``kind``, the columns of the update it is about, and what the processor adds.

    The state of a job is one row and the updates of the last ``delay``.  Updates that are late by more than ``keep``
    are dropped and counted by the engine, those late by less leave as rows of kind ``late``.  Updates without a time
    are left out; those without a job are one job.  The state lives in RocksDB, which is a setting of the session.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    processor.ahead = _millis(spark, keep) - _millis(spark, delay)
    if processor.ahead < 0:
        raise ValueError("keep must not be shorter than delay")
    columns = [c for c in stream.columns if c != CLOSING]
    ends = F.col("status").isin(TERMINAL) if "status" in columns else F.lit(False)
    # A closing row lies behind every update, and only the clock may see it; a condition on the time stays behind the clock.
    open_end = F.col(CLOSING).isNull() | F.col("ts").isNull() if CLOSING in stream.columns else F.lit(True)
    narrow = stream.withWatermark("ts", keep).filter(open_end).select(
        # Keys of a state must not be null.
        F.to_json(F.struct("job_id")).alias("job"), "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(-1)).alias("tie"),
        F.to_json(F.struct(*fields), JSON).alias("now"),
        F.coalesce(ends, F.lit(False)).alias("ends"),
        F.to_json(F.struct(*columns), JSON).alias("whole"),
    )
    narrow = narrow.filter(F.col("at").isNotNull())
    told = narrow.groupBy("job").transformWithStateInPandas(processor, processor.schema, "append", "eventTime")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name != CLOSING)
    more = [c for c in processor.columns if c not in ("kind", "whole")]
    return told.select("kind", F.from_json("whole", shape, JSON).alias("r"), *more).select("kind", "r.*", *more)


def _run(rows: DataFrame, folder: str) -> None:
    query = (
        rows.writeStream.format("parquet")
        .partitionBy("kind")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run_to_end(query)


def feed_table(
    spark: SparkSession, stream: DataFrame, log: DataFrame, delay: str, processor: InOrder, fields: Sequence[str] = CHANGE_FIELDS
) -> DataFrame:
    """A feed over everything that is there now, ``log`` being the same updates as a table; late rows included.

    A first run leaves the updates of the last ``delay`` waiting.  A second one goes on from its checkpoint, with a
    clock that stands behind the newest update.
    """
    folder = work_folder(spark, "feed")
    clock = f"{folder}/clock"
    # A path that exists is needed before the first run; a file without rows moves no clock.
    spark.createDataFrame([], "ts timestamp").coalesce(1).write.mode("append").parquet(clock)
    ticks = spark.readStream.schema("ts timestamp").parquet(clock).withColumn(CLOSING, F.lit(True))
    both = stream.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(ticks, allowMissingColumns=True)
    # Nothing of a table at rest is too late: the span of its times is allowed for.
    times = F.col("ts").cast("timestamp")
    span = log.agg(F.unix_millis(F.max(times)) - F.unix_millis(F.min(times))).first()[0] or 0
    rows = feed(both, delay, processor, fields, f"{span + _millis(spark, delay) + 1} milliseconds")
    _run(rows, folder)
    end = log.agg((F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {delay}") + F.expr("interval 1 millisecond")).alias("ts"))
    end.filter("ts is not null").coalesce(1).write.mode("append").parquet(clock)
    _run(rows, folder)
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _told_anew(told: DataFrame, log: DataFrame, wanted: Column, batch: Callable[[DataFrame], DataFrame], columns: list) -> DataFrame:
    """Rows of the feed of jobs that had no late update, and of the other jobs as ``batch`` tells them."""
    late = told.filter("kind = 'late'").select(F.col("job_id").alias("late_job")).distinct()
    match = F.col("job_id").eqNullSafe(F.col("late_job"))
    straight = told.filter(wanted).join(late, match, "left_anti")
    return straight.select(*columns).unionByName(batch(log.join(late, match, "left_semi")).select(*columns))


def change_table(
    spark: SparkSession, stream: DataFrame, log: DataFrame, delay: str, fields: Sequence[str] = CHANGE_FIELDS
) -> DataFrame:
    """All changes of a log, as ``operators.jobs.progress_changes`` gives them, by the live feed."""
    told = feed_table(spark, stream, log, delay, Changes(), fields)
    return _told_anew(told, log, F.col("kind") == "progress", lambda rows: progress_changes(rows, fields), log.columns)


def done_table(spark: SparkSession, stream: DataFrame, log: DataFrame, delay: str) -> DataFrame:
    """The update that first ended each job with ``run_seconds`` since its first one, by the live feed."""
    told = feed_table(spark, stream, log, delay, Changes(stop=True), ["status"])
    told = told.withColumn("run_seconds", F.col("micros") / F.lit(1_000_000.0))
    return _told_anew(told, log, F.col("kind") == "done", job_ends, [*log.columns, "run_seconds"])


def stall_table(spark: SparkSession, stream: DataFrame, log: DataFrame, delay: str, seconds: float = 15.0) -> DataFrame:
    """Gaps between updates (``next_ts``, ``gap_us``) and jobs that are silent at the end of the log (both null).

    They are those of ``operators.jobs.stalled`` and ``open_stalls``, by the live feed; the clock counts milliseconds.
    """
    told = feed_table(spark, stream, log, delay, Stalls(int(seconds * 1_000_000)), ["status"])
    columns = [*log.columns, "next_ts", "gap_us"]
    told = told.withColumns({"next_ts": F.timestamp_micros("next_at"), "gap_us": F.col("micros")})
    heard = told.filter("kind = 'heard'").select(
        F.col("job_id").alias("heard_job"), F.col("ts").alias("heard_ts"), F.col("event_id").alias("heard_event")
    )
    back = (
        F.col("job_id").eqNullSafe(F.col("heard_job"))
        & F.col("ts").eqNullSafe(F.col("heard_ts"))
        & F.col("event_id").eqNullSafe(F.col("heard_event"))
    )
    silent = told.filter("kind = 'silent'").join(heard, back, "left_anti")
    standing = told.filter("kind <> 'silent'").unionByName(silent)

    def batch(rows: DataFrame) -> DataFrame:
        gaps = stalled(rows, seconds).select(*columns)
        ends = log.agg(F.max("ts")).scalar()
        none = {"next_ts": F.lit(None).cast("timestamp"), "gap_us": F.lit(None).cast("bigint")}
        return gaps.unionByName(open_stalls(rows, seconds, log_end=ends, fields=log.columns).withColumns(none).select(*columns))

    return _told_anew(standing, log, F.col("kind").isin("gap", "silent"), batch, columns)
