"""Removal of every byte that lies in a repeated window of a fixed length.

The windows of all texts are ordered by most-significant-digit passes, only as deep as the threshold; windows that
are still equal after the last digit are exactly the repeated ones.  A radix sort would send every window through
its first pass.  Here the first digit of a window is the string of ``digits[0]`` bytes inside it whose hash is
least.  Equal windows hold it at the same place, and neighbouring windows nearly always share it, so one row stands
for a run of about a hundred windows.  Every pass

* drops the runs whose digit is found nowhere else,
* settles the runs of which a whole copy exists: all their windows repeat,
* hands one copy of each remaining run to the next pass, with a longer digit.

The digit of the last pass is the whole window.  Rows are 64-bit hashes and places; a hot passage is combined on the
map side wherever rows are grouped, and joined to a table with one row per passage.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ROW, arrow_lists, broadcast_if_small, keyed, text_buffer
from .hashing import PIECE, mix, prefix, signed, span

RUNS = "digit bigint, run bigint, row_doc bigint, row_text bigint, at bigint, lo bigint, n int"
#: Rows of run places that may be broadcast to the texts: 32 bytes each.
SMALL = 1_000_000


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    if width == 1:
        return values
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, digit: int):
    """Runs of windows that share their digit: digit hash, run hash, text, first window in it, number of windows."""
    out = []
    place = np.uint64(PIECE - 1)
    a, n = 0, len(data)
    while a + length <= n:
        part = data[a : a + PIECE]
        sums = prefix(part)
        many = len(part) - digit + 1
        hashes = span(sums, slice(0, many), slice(digit, None))
        # The leftmost of equal hashes counts, so the low bits hold the place.
        least = _sliding_least((hashes & ~place) | np.arange(many, dtype=np.uint64), length - digit + 1)
        anchor = (least & place).astype(np.int64)
        docs = np.arange(
            np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, a + len(part), "left")
        )
        ends = np.minimum(offsets[docs + 1] - a, len(part))
        starts = np.maximum(offsets[docs] - a, 0)
        doc_end = np.repeat(offsets[docs + 1] - a, ends - starts)
        inside = np.arange(len(anchor)) + length <= doc_end[: len(anchor)]
        anchor[~inside] = -1
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(edge[1:], len(anchor)) - 1
        held = anchor[edge] >= 0
        edge, last = edge[held], last[held]
        whole = mix(span(sums, edge, last + length) + (last - edge).astype(np.uint64))
        doc = np.searchsorted(offsets, edge + a, "right") - 1
        out.append((hashes[anchor[edge]], whole, doc, edge + a - offsets[doc], last - edge + 1))
        a += PIECE - length + 1
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(batches, length: int, digit: int, of_texts: bool):
    """Runs of whole texts, or of the bytes of runs of an earlier pass (column ``data``, first window ``lo``)."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("text" if of_texts else "data"))
        g, run, doc, lo, n = window_runs(data, offsets, length, digit)
        first = np.asarray(batch.column("lo")) if not of_texts else np.zeros(batch.num_rows, np.int64)
        keys = [np.asarray(batch.column(c))[doc] for c in ROW]
        columns = [signed(g), signed(run), *keys, first[doc], first[doc] + lo, n.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["digit", "run", *ROW, "at", "lo", "n"]
        )


def _cut(batches, length: int):
    """Bytes of the runs named in ``runs`` (first window and number), out of ``data`` that begins at ``from``."""
    for batch in batches:
        data, offsets = text_buffer(batch.column("data"))
        base = np.asarray(batch.column("base"))
        lists = batch.column("runs")
        flat = lists.flatten()
        count = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(batch.num_rows), count)
        lo = np.asarray(flat.field("lo"))
        size = np.asarray(flat.field("n")).astype(np.int64) + length - 1
        start = offsets[row] + lo - base[row]
        pieces = [data[s : s + k].tobytes() for s, k in zip(start.tolist(), size.tolist(), strict=True)]
        keys = [pa.array(np.asarray(batch.column(c))[row]) for c in ROW]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(lo), pa.array(pieces, pa.binary())], names=[*ROW, "lo", "data"])


def _settle(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of which a whole copy exists, and one copy of every other run that may still hold repeated windows."""
    kinds = stage(
        runs.groupBy("digit", "run").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct(*ROW, "at", "lo", "n")).alias("one")
        ),
        "suffix-kinds",
    )
    settled = runs.join(kinds.filter("copies > 1").select("digit", "run"), ["digit", "run"]).select(*ROW, "lo", "n")
    groups = stage(
        kinds.groupBy("digit")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest"))
        .filter("kinds > 1 and fewest = 1")
        .select("digit"),
        "suffix-groups",
    )
    left = kinds.join(groups, "digit").select("one.*")
    return settled, left


def repeated_windows(docs: DataFrame, length: int, digits: tuple[int, ...]) -> DataFrame:
    """Runs of repeated windows: row key, first window (byte), number of windows.  Runs may meet or overlap."""
    rows = keyed(docs).filter(F.octet_length("text") >= length)
    every = rows.select(*ROW, "text").mapInArrow(partial(_runs, length=length, digit=digits[0], of_texts=True), RUNS)
    common = stage(every.groupBy("digit").count().filter("count > 1").select("digit"), "suffix-digits")
    runs = stage(every.join(common, "digit"), "suffix-runs")
    found = []
    data = rows.select(*ROW, F.lit(0).cast("bigint").alias("base"), F.col("text").cast("binary").alias("data"))
    for digit in (*digits[1:], length):
        settled, left = _settle(runs.select("digit", "run", *ROW, "at", "lo", "n"))
        found.append(settled)
        by = [*ROW, "at"] if digit != digits[1] else list(ROW)
        wanted = stage(left.groupBy(*by).agg(F.collect_list(F.struct("lo", "n")).alias("runs")), "suffix-wanted")
        wanted = broadcast_if_small(wanted, wanted.agg(F.sum(F.size("runs"))).first()[0] or 0, SMALL)
        if "at" in by:
            wanted = wanted.withColumnRenamed("at", "base")
            by = [*ROW, "base"]
        cut = data.join(wanted, by).select(*ROW, "base", "data", "runs")
        bytes_of = stage(
            cut.mapInArrow(partial(_cut, length=length), "row_doc bigint, row_text bigint, lo bigint, data binary"),
            "suffix-bytes",
        )
        runs = stage(bytes_of.mapInArrow(partial(_runs, length=length, digit=digit, of_texts=False), RUNS), "suffix-runs")
        data = bytes_of.withColumnRenamed("lo", "base")
    found.append(_settle(runs)[0])
    return reduce(DataFrame.unionByName, found)


def _remove(batches, length: int):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        lists = batch.column("runs")
        bounds = np.asarray(lists.offsets)
        flat = lists.flatten()
        lo, n = np.asarray(flat.field("lo")), np.asarray(flat.field("n"))
        starts, ends, counts, kept = [], [], [], []
        for k in range(batch.num_rows):
            text = data[offsets[k] : offsets[k + 1]]
            a, b = bounds[k], bounds[k + 1]
            if a == b:
                counts.append(0)
                kept.append(text.tobytes())
                continue
            order = np.argsort(lo[a:b], kind="stable")
            s = lo[a:b][order]
            e = np.maximum.accumulate(s + n[a:b][order] + length - 1)
            opens = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
            s, e = s[opens], e[np.append(opens[1:], len(e)) - 1]
            counts.append(len(s))
            starts.append(s)
            ends.append(e)
            edges = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(text)]]).astype(np.int64)
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(join(starts)), pa.array(join(ends))], ["start", "end"])
        at = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(at, spans), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, length: int = 400, digits: tuple[int, ...] | None = None) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Returns ``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs, bytes, end exclusive) and ``kept`` (the
    remaining bytes), one row per row of ``docs``.

    Strings never cross texts; copies inside one text and overlapping copies count.  A null text is an empty one.
    A text shorter than ``length`` is kept whole.  Repeated rows are texts of their own, so two equal rows of
    ``length`` bytes or more remove each other.  Rows with a null ``doc_id`` are treated like all others.  An empty
    table gives an empty one.  Other columns are ignored.
    """
    digits = digits or (length // 2, length * 4 // 5, length * 47 // 50)
    spans = repeated_windows(docs, length, digits)
    per_row = spans.groupBy(*ROW).agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    empty = F.array().cast("array<struct<lo:bigint,n:int>>")
    joined = keyed(docs).join(per_row, ROW, "left").select("doc_id", "text", F.coalesce("runs", empty).alias("runs"))
    return joined.mapInArrow(
        partial(_remove, length=length),
        "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary",
    )
