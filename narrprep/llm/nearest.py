"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by themselves; a pair of centroids is a cell.  A query walks the cells in order
of the summed products of its halves with the two centroids, by a heap over the two sorted lists, until the cells
hold enough vectors.  The cells of one first centroid lie together, in blocks of bounded size; queries that visit any of
them are grouped likewise, so that a hot centroid is many blocks.  A block of vectors and a block of queries meet in
one task, where the cells visited are ranked by the exact inner product.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Centroids per half, at most, and vectors per cell that their number aims at.
CENTROIDS, PER_CELL = 256, 8
#: Vectors and queries in a block.
BLOCK = 1024
ROUNDS = 12


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part, each id once."""
    values = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(ident).cast("bigint").alias("vec_id"), values.alias("vector"))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & F.forall("vector", lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    )
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def fit_centroids(sample: np.ndarray, k: int) -> list[np.ndarray]:
    """k-means of both halves of the vectors."""
    out = []
    cut = (sample.shape[1] + 1) // 2
    for half in (sample[:, :cut], sample[:, cut:]):
        rng = np.random.default_rng(3)
        kinds = np.unique(half, axis=0)
        centres = kinds[rng.permutation(len(kinds))[:k]]
        for _ in range(ROUNDS):
            owner = _closest(half, centres)
            count = np.bincount(owner, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, owner, half)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        out.append(centres)
    return out


def _closest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(half @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _assign(batches, centres: list[np.ndarray]):
    cut = centres[0].shape[1]
    for batch in batches:
        x = _matrix(batch.column("vector"))
        i, j = _closest(x[:, :cut], centres[0]), _closest(x[:, cut:], centres[1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=[*batch.schema.names, "i", "j"]
        )


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells in falling order of the sum of both products, until they hold ``enough`` vectors."""
    first, second = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, first, second = a[first].tolist(), b[second].tolist(), first.tolist(), second.tolist()
    heap, seen, cells, total = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        n = int(held[first[i], second[j]])
        if n:
            cells.append((first[i], second[j]))
            total += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[x] + b[y]), x, y))
    return cells


def _visits(batches, centres: list[np.ndarray], held: np.ndarray, enough: int):
    """Queries with the second centroids that they visit under each first centroid."""
    cut = centres[0].shape[1]
    for batch in batches:
        x = _matrix(batch.column("vector"))
        one, two = x[:, :cut] @ centres[0].T, x[:, cut:] @ centres[1].T
        rows, firsts, visited = [], [], []
        for row, (a, b) in enumerate(zip(one, two, strict=True)):
            under: dict[int, list[int]] = {}
            for i, j in walk(a, b, held, enough):
                under.setdefault(i, []).append(j)
            rows += [row] * len(under)
            firsts += under.keys()
            visited += under.values()
        take = pa.array(rows, pa.int64())
        columns = [c.take(take) for c in batch.columns]
        columns += [pa.array(firsts, pa.int32()), pa.array(visited, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "i", "visited"])


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order wherever the vector stands."""
    return (vectors * query).sum(axis=1)


def _rank(entries: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best of a block of vectors for every query of a block; equal products all stay."""
    none = pa.table({"one": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not entries.num_rows or not queries.num_rows:
        return none
    e, q = (_matrix(t.column("vector").combine_chunks()) for t in (entries, queries))
    e_ids, q_ids = (np.asarray(t.column("one")) for t in (entries, queries))
    j = np.asarray(entries.column("j"))
    lists = queries.column("visited").combine_chunks()
    visited = np.zeros((len(q), max(int(j.max()), int(np.asarray(lists.flatten()).max())) + 1), bool)
    visited[np.repeat(np.arange(len(q)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())] = True
    near = np.where(visited[:, j], q @ e.T, -np.inf)
    cut = np.partition(near, -k, axis=1)[:, -k] - 1e-9 if near.shape[1] > k else np.full(len(q), -np.inf)
    of, hit = np.nonzero((near >= cut[:, None]) & np.isfinite(near))
    return pa.table({"one": q_ids[of], "found": e_ids[hit], "score": exact_products(e[hit], q[of])})


def _blocks() -> Column:
    """Blocks that the rows of a group fill."""
    return F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("bigint")


def nearest(
    vectors: DataFrame, asked: Column, k: int = 20, share: float = 0.55, least: int = 4000,
    ident: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``k`` vectors with the largest inner product of every query (rows for which ``asked`` holds), out of the
    best cells that hold ``share`` of all vectors, ``least`` at least (the whole table where it is not larger).

    ``share`` buys recall: vectors without any structure need half of the table for nine tenths of the true
    neighbours, clustered ones far less.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``.  Ties go to the smaller id; a query is not its own
    neighbour, but its copies are.  Vectors that are null, zero, hold a null or a value that is not finite, or have
    another length than most, take no part, nor do rows without an id.  Repeated ids count once, with the least
    vector.  Fewer rows come back where fewer candidates exist; an empty table gives an empty one.

    Equal vectors are searched as one that carries its ``k`` + 1 least ids, which is all that ranks can show.
    """
    rows = stage(usable(vectors, ident, vector), "nearest-rows")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("vector") == sizes["size"])
    first = Window.partitionBy("vector").orderBy("vec_id")
    ids = rows.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    kinds = stage(ids.groupBy("vector").agg(F.min("vec_id").alias("one"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "nearest-kinds")
    n = kinds.count()
    sample = kinds.orderBy(F.xxhash64("one")).limit(SAMPLE).select("vector").toArrow()
    sample = _matrix(sample.column("vector").combine_chunks())
    many = int(np.clip(round(np.sqrt(n / PER_CELL)), 1, CENTROIDS))
    centres = fit_centroids(sample, many)
    cells = stage(
        kinds.mapInArrow(partial(_assign, centres=centres), "vector array<double>, one bigint, ids array<bigint>, i int, j int"), "nearest-cells"
    )
    # One row per cell: at most the square of CENTROIDS.
    held = np.zeros((len(centres[0]), len(centres[1])), np.int64)
    for r in cells.groupBy("i", "j").count().collect():
        held[r["i"], r["j"]] = r["count"]

    query_rows = rows.filter(asked).select(F.col("vec_id").alias("query_id"), "vector")
    queries = query_rows.select("vector").distinct().join(kinds.select("vector", "one"), "vector")
    enough = max(least, int(np.ceil(share * n)))
    visits = stage(
        queries.mapInArrow(
            partial(_visits, centres=centres, held=held, enough=enough), "vector array<double>, one bigint, i int, visited array<int>"
        ),
        "nearest-visits",
    )
    blocks = cells.groupBy("i").agg(_blocks().alias("parts")).join(visits.groupBy("i").agg(_blocks().alias("query_parts")), "i")
    # One row per first centroid.
    blocks = F.broadcast(blocks)
    deal = lambda parts: F.pmod(F.xxhash64("one"), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(parts) - 1))
    entry_blocks = cells.join(blocks, "i").select("i", deal("parts").alias("part"), every("query_parts").alias("query_part"), "one", "vector", "j")
    query_blocks = visits.join(blocks, "i").select("i", every("parts").alias("part"), deal("query_parts").alias("query_part"), "one", "vector", "visited")
    key = ["i", "part", "query_part"]
    found = entry_blocks.groupBy(*key).cogroup(query_blocks.groupBy(*key)).applyInArrow(
        lambda entries, queries: _rank(entries, queries, k + 1), "one bigint, found bigint, score double"
    )
    best = Window.partitionBy("one").orderBy(F.desc("score"), "found")
    found = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).drop("at")
    ids_of = kinds.select(F.col("one").alias("found"), "ids")
    answers = found.join(ids_of, "found").select("one", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("one").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).drop("at")
    answers = stage(answers, "nearest-answers")
    each = query_rows.join(kinds.select("vector", "one"), "vector").select("query_id", "one")
    out = each.join(answers, "one").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
