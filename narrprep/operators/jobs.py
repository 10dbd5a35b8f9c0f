"""Job log: current state, changes, stalls, transitions, timings and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import TAIL
from ..functions.text import base_name, suffix
from .scan import effect_of, ordered_scan, states_before, time_block
from .sections import first_rows

# Job states and the changes between them that are allowed.
STATUSES = ["pending", "processing", "completed", "failed", "cancelled"]
TERMINAL = ["completed", "failed", "cancelled"]
TRANSITIONS = [
    ("pending", "processing"),
    ("pending", "cancelled"),
    ("pending", "failed"),
    ("processing", "completed"),
    ("processing", "failed"),
    ("processing", "cancelled"),
]
MIN_SPEED = 0.5
MAX_SPEED = 2.0
PAGE_SIZE = 20
MAX_PAGE_SIZE = 100

CHANGE_FIELDS = ["status", "stage", "percent", "chunk", "message"]


def latest_state(log: DataFrame, fields: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Last state of every job: a fold of the log, combined before the shuffle."""
    state = F.max_by(F.struct(*fields), F.struct(*order)).alias("s")
    return log.groupBy("job_id").agg(state, F.count(F.lit(1)).alias("n_updates")).select(
        "job_id", *[F.col(f"s.{f}").alias(f) for f in fields], "n_updates"
    )


def current_view(log: DataFrame) -> DataFrame:
    """Job as shown to its owner: missing numbers are 0, completed jobs at 100."""
    last = latest_state(log, ["status", "stage", "percent", "chunk", "message"])
    percent = F.when(F.col("status") == "completed", F.lit(100.0)).otherwise(F.coalesce("percent", F.lit(0.0)))
    return last.select(
        "job_id",
        "status",
        F.struct(
            "stage",
            percent.alias("percent"),
            F.coalesce("chunk", F.lit(0)).alias("chunk"),
            "message",
        ).alias("progress"),
    )


def progress_changes(
    log: DataFrame,
    fields: Sequence[str] = CHANGE_FIELDS,
    order: Sequence[str] = ("ts", "event_id"),
    block: Column | None = None,
) -> DataFrame:
    """Log rows whose state differs from the row before of the same job."""
    state = F.struct(*fields)
    scanned = ordered_scan(
        log, ["job_id"], order, time_block(order[0]) if block is None else block,
        previous={"__before": F.struct(F.lit(True).alias("seen"), state.alias("state"))},
    )
    changed = F.col("__before").isNull() | ~F.col("__before")["state"].eqNullSafe(state)
    return scanned.filter(changed).drop("__before")


def until_terminal(log: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Log rows up to the first terminal one of every job, which ends its feed."""
    scanned = ordered_scan(
        log, ["job_id"], order, time_block(order[0]),
        sum_before={"__ended": F.col("status").isin(TERMINAL).cast("int")},
    )
    return scanned.filter("__ended = 0").drop("__ended")


def stalled(
    log: DataFrame, seconds: float = 15.0, order: Sequence[str] = ("ts", "event_id"), block: Column | None = None
) -> DataFrame:
    """Gaps between two updates of a job that are longer than ``seconds``."""
    scanned = ordered_scan(
        log, ["job_id"], order, time_block(order[0]) if block is None else block,
        following={"next_ts": F.col(order[0])},
    )
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col(order[0]).cast("timestamp"))
    return scanned.withColumn("gap_us", micros).filter(F.col("gap_us") > int(seconds * 1_000_000))


def open_stalls(
    log: DataFrame, seconds: float = 15.0, log_end: Column | None = None, fields: Sequence[str] = ("status", "stage", "ts")
) -> DataFrame:
    """Jobs that have not ended and whose last update lies more than ``seconds`` before the end of the log.

    A job that went silent and never came back has no later update to measure a gap by.  ``log_end`` is the time of the
    newest update where ``log`` is not the whole log; ``fields`` of the last update are returned, ``status`` and ``ts``
    among them.
    """
    last = latest_state(log, [f for f in fields if f != "job_id"])
    ended = F.coalesce(F.col("status").isin(TERMINAL), F.lit(False))
    end = log.agg(F.max("ts")).scalar() if log_end is None else log_end
    silent = last.filter(~ended).withColumn("log_end", end)
    micros = F.unix_micros(F.col("log_end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return silent.withColumn("silent_us", micros).filter(F.col("silent_us") > int(seconds * 1_000_000))


def job_ends(log: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The update that first ended each job, with ``run_seconds`` since the first update of the job."""
    position = F.struct(*order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    first = log.groupBy("job_id").agg(
        F.min(order[0]).alias("first_ts"),
        F.min_by(F.struct(*log.columns), F.when(F.col("status").isin(TERMINAL), position)).alias("r"),
    )
    return first.filter("r is not null").select("r.*", "first_ts").withColumn(
        "run_seconds", (micros(F.col(order[0])) - micros(F.col("first_ts"))) / F.lit(1_000_000.0)
    ).drop("first_ts")


def illegal_transitions(log: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Status changes that are not allowed, such as cancelled to completed."""
    scanned = ordered_scan(
        log, ["job_id"], order, time_block(order[0]), previous={"from_status": F.col("status")}
    )
    pair = F.concat_ws(">", "from_status", "status")
    allowed = [f"{a}>{b}" for a, b in TRANSITIONS]
    return scanned.filter(
        F.col("from_status").isNotNull()
        & (F.col("from_status") != F.col("status"))
        & ~pair.isin(allowed)
    )


def can_cancel(status: Column) -> Column:
    return status.isin("pending", "processing")


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "pending")


def owned_job(jobs: DataFrame, job_id, user_id) -> DataFrame:
    return jobs.filter((F.col("job_id") == job_id) & (F.col("user_id") == user_id))


def _check_page(limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE_SIZE} jobs, not {limit}")


def list_jobs(jobs: DataFrame, user_id, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """One page of a user's jobs, newest first."""
    _check_page(limit)
    return (
        jobs.filter(F.col("user_id") == user_id)
        .orderBy(F.col("created_at").desc(), F.col("job_id"))
        .offset(offset)
        .limit(limit)
    )


def job_pages(jobs: DataFrame, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """The same page for every user; rows behind it are dropped before the shuffle."""
    _check_page(limit)
    return first_rows(jobs, ["user_id"], [F.col("created_at").desc(), F.col("job_id")], limit, offset)


def job_timings(log: DataFrame) -> DataFrame:
    """Created, started and ended times of every job and the seconds between them."""

    def first_of(*statuses: str) -> Column:
        return F.min(F.when(F.col("status").isin(*statuses), F.col("ts")))

    def seconds(later: str, earlier: str) -> Column:
        micros = F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))
        return F.floor(micros / F.lit(1_000_000)).cast("bigint")

    times = log.groupBy("job_id").agg(
        first_of("pending").alias("created_at"),
        first_of("processing").alias("started_at"),
        first_of(*TERMINAL).alias("completed_at"),
    )
    return times.withColumns(
        {
            "wait_seconds": seconds("started_at", "created_at"),
            "run_seconds": seconds("completed_at", "started_at"),
        }
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with an allowed speed, and the rejected ones."""
    ok = F.coalesce(F.col("speed").between(MIN_SPEED, MAX_SPEED), F.lit(False))
    return requests.filter(ok), requests.filter(~ok)


def requested_chapters(jobs: DataFrame, keys: Sequence[str], column: str = "chapters_to_convert") -> DataFrame:
    """One row per chapter number of a JSON list; jobs without a list give none."""
    return jobs.select(
        *keys, F.explode(F.from_json(F.col(column), "array<int>")).alias("chapter_no")
    ).filter("chapter_no is not null")


def progress_json(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Key and JSON value of every update, as a message sink takes them."""
    return log.select(F.col("job_id").cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def new_jobs(requests: DataFrame) -> DataFrame:
    """Pending jobs of requests (user_id, upload_key, created_at, chapters array, …).

    The id is made from the request, so that a task that runs again makes the
    same job.
    """
    name = base_name(F.col("upload_key"))
    identity = F.concat_ws("|", F.col("user_id").cast("string"), "upload_key", F.col("created_at").cast("string"))
    chapters = F.when(F.size("chapters") > 0, F.to_json("chapters"))
    return requests.select(
        F.substring(F.sha2(identity, 256), 1, 32).alias("job_id"),
        "user_id",
        F.lit("pending").alias("status"),
        name.alias("input_filename"),
        F.substr(suffix(name), F.lit(2)).alias("input_format"),
        chapters.alias("chapters_to_convert"),
        "created_at",
    )


def apply_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Status after one update per job, with the reason where it was refused.

    ``updates`` holds ``job_id`` and ``to_status``; jobs that are not known
    are refused too.  A completed job is at 100 percent.
    """
    pair = F.concat_ws(">", "status", "to_status")
    allowed = pair.isin([f"{a}>{b}" for a, b in TRANSITIONS])
    reason = (
        F.when(F.col("status").isNull(), "unknown job")
        .when((F.col("to_status") == "cancelled") & ~can_cancel(F.col("status")),
              F.concat(F.lit("too late to cancel, status "), "status"))
        .when(~allowed, F.concat(F.lit("Not allowed: "), pair))
    )
    joined = updates.join(current.select("job_id", "status"), "job_id", "left")
    status = F.when(reason.isNull(), F.col("to_status")).otherwise(F.col("status"))
    return joined.select(
        "job_id",
        status.alias("status"),
        F.when(reason.isNull() & (F.col("to_status") == "completed"), F.lit(100.0)).alias("percent"),
        reason.alias("refused"),
    )


#: States a job can be in before an update; the last one stands for a job that is not known.
_KNOWN = [*STATUSES, None]


def _after(state: Column, to: Column) -> Column:
    """Number of the state after an update to state number ``to`` (from 0, null for no state at all)."""
    width = len(STATUSES)
    table = [
        b if a is not None and (a, STATUSES[b]) in TRANSITIONS else k for k, a in enumerate(_KNOWN) for b in range(width)
    ]
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in table]), state * width + to), state)


def apply_update_log(
    current: DataFrame,
    updates: DataFrame,
    order: Sequence[str] = ("ts", "event_id"),
    block: Column | None = None,
    levels: int = 1,
    fan: int = 1024,
) -> DataFrame:
    """Every update of an ordered log with the state before and after it, and the reason where it was refused.

    ``current`` holds ``job_id`` and ``status`` as they stand before the log, ``updates`` holds ``job_id``,
    ``to_status`` and the order columns (unique per job, not null), any number per job.  A refused update leaves the
    state as it is.  Returned are ``job_id``, the order columns, ``to_status``, ``from_status``, ``status``,
    ``percent`` (100 where a job is completed) and ``refused``.  Jobs that are not in ``current`` have no state and all
    their updates are refused; a null job and a state of another name are none that is known.

    An update maps states to states, and so does any run of updates.  The log of a job is cut into blocks by its order;
    each block becomes such a map, maps are composed in blocks of ``fan``, and a block is then gone through once more
    from the state it finds.  So no task holds more than a block of a job, or ``fan`` maps.
    """
    order = list(order)
    block = time_block(order[0]) if block is None else block
    number = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in STATUSES]), c), F.lit(0)) - 1
    name = lambda state: F.get(F.array(*[F.lit(x).cast("string") for x in _KNOWN]), state)
    key = F.struct(F.col("job_id"))
    unknown = len(STATUSES)
    known = current.select(key.alias("key"), F.coalesce(number(F.col("status")), F.lit(unknown)).cast("int").alias("state"))
    known = known.filter("key.job_id is not null")
    step = lambda s, u: _after(s, u["to"])
    update = F.struct(*order, F.coalesce(F.col("to_status"), F.lit("")).alias("to_status"), number(F.col("to_status")).cast("int").alias("to"))
    cells = updates.groupBy(key.alias("key"), block.alias("no")).agg(F.array_sort(F.collect_list(update)).alias("updates"))
    runs = cells.select("key", "no", effect_of(F.col("updates"), step, unknown + 1).alias("effect"))
    cells = cells.join(states_before(runs, known, unknown + 1, unknown, levels, fan), ["key", "no"])

    kind = dict(updates.dtypes)
    shape = ",".join([*[f"{c}:{kind[c]}" for c in order], "to_status:string", "a:int", "b:int"])
    zero = F.struct(F.col("state").alias("state"), F.array().cast(f"array<struct<{shape}>>").alias("tail"), F.array().cast(f"array<array<struct<{shape}>>>").alias("done"))

    def replay(acc: Column, u: Column) -> Column:
        after = _after(acc["state"], u["to"])
        row = F.struct(*[u[c].alias(c) for c in order], u["to_status"].alias("to_status"), acc["state"].alias("a"), after.alias("b"))
        full = F.size(acc["tail"]) >= TAIL
        return F.struct(
            after.alias("state"),
            F.when(full, F.array(row)).otherwise(F.concat(acc["tail"], F.array(row))).alias("tail"),
            F.when(full, F.concat(acc["done"], F.array(acc["tail"]))).otherwise(acc["done"]).alias("done"),
        )

    told = F.aggregate("updates", zero, replay, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["tail"]))))
    rows = cells.select("key.job_id", F.inline(told))
    before, after, to = name(F.col("a")), name(F.col("b")), F.col("to_status")
    pair = F.concat_ws(">", before, to)
    allowed = pair.isin([f"{x}>{y}" for x, y in TRANSITIONS])
    reason = (
        F.when(before.isNull(), "unknown job")
        .when((to == "cancelled") & ~can_cancel(before), F.concat(F.lit("too late to cancel, status "), before))
        .when(~allowed, F.concat(F.lit("Not allowed: "), pair))
    )
    return rows.select(
        "job_id", *order, F.nullif(to, F.lit("")).alias("to_status"), before.alias("from_status"), after.alias("status"),
        F.when(reason.isNull() & (to == "completed"), F.lit(100.0)).alias("percent"), reason.alias("refused"),
    )
