"""Append-only store of the rows of documents: runs, of which the newest that holds a document counts.

A run is a folder of its own with its rows (``data``) and a key manifest (``keys``): one row per document with its
number of rows.  The manifest is written last, and a run without a finished manifest is not there: a write that was
killed leaves the former state readable.  Nothing that is stored is rewritten by an increment; ``compact`` gathers runs
into one that replaces them, and the folders it replaced stay until ``drop_replaced``.

Run folders sort by their names: a number that rises with every run, then ``c`` (compacted) or ``r``.  A compacted run
has the number of the last run it holds.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"run=(\d{12})([cr])-[0-9a-f]{32}")
#: Replaced documents that may be broadcast, 24 bytes each.
SMALL = 1_000_000


def _folders(spark: SparkSession, path: str) -> dict[str, bool]:
    """Run folders by name, and whether their manifest is finished."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    names = sorted(s.getPath().getName() for s in files.listStatus(root) if NAME.fullmatch(s.getPath().getName()))
    done = spark._jvm.org.apache.hadoop.fs.Path
    return {n: files.exists(done(f"{path}/{n}/keys/_SUCCESS")) for n in names}


def _number(name: str) -> int:
    return int(NAME.fullmatch(name)[1])


def _current(folders: dict[str, bool]) -> list[str]:
    """Finished runs, oldest first, without those that a compacted one replaces."""
    finished = [n for n, ok in folders.items() if ok]
    compacted = [n for n in finished if NAME.fullmatch(n)[2] == "c"]
    if not compacted:
        return finished
    last = compacted[-1]
    return [last, *[n for n in finished if _number(n) > _number(last)]]


def _write(rows: DataFrame, path: str, name: str, key: str, documents: DataFrame | None) -> None:
    spark, folder = rows.sparkSession, f"{path}/{name}"
    # Rows of a document lie in few files, sorted, so that a look-up by key skips row groups.
    rows.hint("rebalance", key).sortWithinPartitions(key).write.mode("error").parquet(f"{folder}/data")
    keys = spark.read.schema(rows.schema).parquet(f"{folder}/data").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    if documents is not None:
        named = documents.select(F.col(key), F.lit(0).cast("bigint").alias("n_rows")).unionByName(keys)
        keys = named.groupBy(key).agg(F.max("n_rows").alias("n_rows"))
    keys.write.mode("error").parquet(f"{folder}/keys")


def append_run(rows: DataFrame, path: str, key: str = "doc_id", documents: DataFrame | None = None) -> str:
    """Store the rows of some documents as a new run; from then on they replace all older rows of these documents.

    ``documents`` (column ``key``) names documents that are replaced even where ``rows`` holds none of theirs.  Rows
    with a null key are those of one document.  Returns the name of the run.
    """
    path = path.rstrip("/")
    number = max(map(_number, _folders(rows.sparkSession, path)), default=0) + 1
    name = f"run={number:012d}r-{uuid.uuid4().hex}"
    _write(rows, path, name, key, documents)
    return name


def stored_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame | None:
    """Every stored document (``key``), its run (``run_no``), its number of rows, and whether a newer run replaced it."""
    path = path.rstrip("/")
    runs = _current(_folders(spark, path))
    if not runs:
        return None
    parts = [spark.read.parquet(f"{path}/{n}/keys").withColumn("run_no", F.lit(k)) for k, n in enumerate(runs)]
    every = reduce(DataFrame.unionByName, parts)
    newest = every.groupBy(key).agg(F.max("run_no").alias("newest"))
    joined = every.withColumnRenamed(key, "stored_key").join(newest, F.col("stored_key").eqNullSafe(F.col(key)))
    return joined.select(key, "run_no", "n_rows", (F.col("run_no") < F.col("newest")).alias("replaced"))


def read_store(spark: SparkSession, path: str, key: str = "doc_id", where: Column | None = None) -> DataFrame:
    """Rows of all documents as their newest run holds them; of documents that meet ``where`` (a condition on ``key``).

    Only manifests are grouped.  Rows are held against the replaced documents, which are broadcast where they are few;
    with one run they are read as they are.  An empty store is an error, as its columns are not known.
    """
    path = path.rstrip("/")
    runs = _current(_folders(spark, path))
    if not runs:
        raise ValueError(f"{path} holds no finished run")
    data = [spark.read.parquet(f"{path}/{n}/data") for n in runs]
    if where is not None:
        data = [d.filter(where) for d in data]
    if len(runs) == 1:
        return data[0]
    every = stored_documents(spark, path, key)
    old = every.filter("replaced and n_rows > 0").select(F.col(key).alias("old_key"), F.col("run_no").alias("old_run"))
    if where is not None:
        old = old.withColumn(key, F.col("old_key")).filter(where).drop(key)
    if old.count() <= SMALL:
        old = F.broadcast(old)
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("old_no", F.lit(k)) for k, d in enumerate(data)]
    )
    return rows.join(old, F.col(key).eqNullSafe(F.col("old_key")) & (F.col("old_no") == F.col("old_run")), "left_anti").drop("old_no")


def compact(spark: SparkSession, path: str, key: str = "doc_id") -> str | None:
    """Gather finished runs into one; None where there is nothing to gather.

    Runs behind one that is not finished are left out, so that a run still being written keeps its place; a run that was
    killed is removed with ``discard``.
    """
    path = path.rstrip("/")
    folders = _folders(spark, path)
    current = _current(folders)
    open_runs = [_number(n) for n, ok in folders.items() if not ok and NAME.fullmatch(n)[2] == "r"]
    kept = [n for n in current if _number(n) < min(open_runs, default=10**12)]
    if len(kept) < 2:
        return None
    last = kept[-1]
    parts = [spark.read.parquet(f"{path}/{n}/keys").withColumn("run_no", F.lit(k)) for k, n in enumerate(kept)]
    newest = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.max("run_no").alias("newest"))
    newest = newest.withColumnRenamed(key, "stored_key")
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [spark.read.parquet(f"{path}/{n}/data").withColumn("old_no", F.lit(k)) for k, n in enumerate(kept)],
    )
    match = F.col(key).eqNullSafe(F.col("stored_key")) & (F.col("old_no") == F.col("newest"))
    name = f"run={_number(last):012d}c-{uuid.uuid4().hex}"
    _write(rows.join(newest, match, "left_semi").drop("old_no"), path, name, key, None)
    return name


def discard(spark: SparkSession, path: str, name: str) -> None:
    """Remove a run that was never finished."""
    path = path.rstrip("/")
    if _folders(spark, path).get(name, True):
        raise ValueError(f"{name} is no unfinished run of {path}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_replaced(spark: SparkSession, path: str) -> list[str]:
    """Remove the finished runs that a compacted one replaced, when no reader needs them any more."""
    path = path.rstrip("/")
    folders = _folders(spark, path)
    current = _current(folders)
    compacted = [n for n in current if NAME.fullmatch(n)[2] == "c"]
    last = _number(compacted[-1]) if compacted else -1
    gone = [n for n, ok in folders.items() if ok and n not in current and _number(n) <= last]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
