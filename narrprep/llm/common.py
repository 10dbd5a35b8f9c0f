"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row of a corpus is named by its id and a hash of its text, so that rows that share an id stay apart
#: and rows that are equal in both share one answer.  Neither is ever null.
ROW = ["row_doc", "row_text"]

#: What Python workers keep from task to task; they live on and run tasks of other steps.
KEPT: list[dict] = []


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, a null text as an empty one; other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def row_key(doc: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc.cast("bigint"), F.lit(-1)).alias(ROW[0]), F.xxhash64(F.coalesce(text, F.lit(""))).alias(ROW[1])]


def keyed(docs: DataFrame) -> DataFrame:
    rows = texts(docs)
    return rows.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc: Column) -> Column:
    """Rows whose label is never learned from; a row without an id has no label."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast hint for a table of at most ``most`` rows; ``rows`` is its measured count, a larger one is shuffled."""
    return F.broadcast(df) if rows <= most else df


def join_hot(rows: DataFrame, unique: DataFrame, keys: str | list[str], matches: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table that holds every key once and, in ``matches``, its number of rows.

    ``total`` is the number of all ``rows``.  Keys with more than a thousandth of them, which are fewer than a thousand,
    are broadcast; all others are shuffled, and none of those can fill a task.  Keys must not be null.
    """
    keys = [keys] if isinstance(keys, str) else keys
    many = F.col(matches) > max(total // 1000, 1000)
    hot = F.broadcast(unique.filter(many))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(unique.filter(~many), keys)
    return rows.join(hot, keys).unionByName(rest)


def let_go() -> None:
    """A worker gives back what tasks of other steps have left in it."""
    for kept in KEPT:
        kept.clear()
    pa.default_memory_pool().release_unused()


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a batch, and where each begins and ends."""
    if array.null_count:
        array = pc.fill_null(array, pa.scalar(b"" if pa.types.is_binary(array.type) else "", array.type))
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring texts taken together up to ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def arrow_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Array of lists out of flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
