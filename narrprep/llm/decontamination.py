"""Documents that hold benchmark items, found by fingerprints of item-sized windows.

Every item is cut into windows somewhat shorter than itself, of one of a few sizes, and every window gets a 64-bit
SimHash of its word pairs.  Windows of the same sizes slide over the documents.  Fingerprints are split into four
blocks; two that differ in at most ``radius`` bits differ in at most radius // 4 bits in one block, so looking up
every block value within that distance finds all of them.  Candidates are then compared by the weighted shingles of
the whole item and the stretch of text it would lie on.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import fresh, runs, text_buffer
from .hashing import PIECE, PLAIN_WORDS, pairs, shingles, tokens

#: Items that are searched at a time, and their characters; a larger benchmark takes more passes over the documents.
ITEMS = 2_000
CHARACTERS = 4_000_000
BLOCKS = 4
WIDTH = 64 // BLOCKS
_STEP = 4096
HIT = StructType(
    [
        StructField("item_id", LongType()),
        StructField("start", LongType()),
        StructField("n_words", LongType()),
        StructField("similarity", DoubleType()),
    ]
)


def _size(words: int) -> int:
    """Window size for an item: at most three quarters of its words, out of a geometric row."""
    most = words * 3 // 4
    size = 2
    while (more := max(size + 1, size * 23 // 20)) <= most:
        size = more
    return size


def _features(h: np.ndarray) -> np.ndarray:
    """Bits of every word pair, one row each."""
    return np.unpackbits(pairs(h).view(np.uint8).reshape(-1, 8), axis=1)


class _Sums:
    """Ones per bit over any number of rows that follow each other, out of sums over powers of two."""

    def __init__(self, bits: np.ndarray, most: int):
        kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32
        self.levels = [bits.astype(kind, copy=False)]
        while 2 << (len(self.levels) - 1) <= most:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(last[:-step] + last[step:] if len(last) > step else last[:0])

    def over(self, n: int, first: int, step: int, many: int) -> np.ndarray:
        """Ones of ``many`` runs of n rows that begin ``step`` apart."""
        total, offset = None, first
        for k, level in enumerate(self.levels):
            if n >> k & 1:
                part = level[offset : offset + (many - 1) * step + 1 : step]
                total = part if total is None else total + part
                offset += 1 << k
        return total


def _fingerprints(sums: _Sums, size: int, first: int, step: int, many: int) -> np.ndarray:
    n = size - 1
    return np.packbits(sums.over(n, first, step, many) > n // 2, axis=1).view(np.uint64).ravel()


def _values(prints: np.ndarray) -> np.ndarray:
    """Value of every block, a row per block."""
    shifts = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(WIDTH)
    return ((prints[None, :] >> shifts[:, None]) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


class Items:
    """Fingerprints and shingles of the benchmark items of one pass."""

    def __init__(self, ids: list[int], item_texts: list[str], radius: int, threshold: float):
        data, offsets = text_buffer(pa.array(item_texts, pa.string()))
        doc, _, h, _, _ = tokens(data, offsets, 0, len(item_texts), PLAIN_WORDS) if len(data) else (np.zeros(0, int),) * 5
        bounds = np.searchsorted(doc, np.arange(len(item_texts) + 1))
        self.threshold, self.radius = threshold, radius
        self.ids, self.words, self.sets = [], [], []
        kept: list[np.ndarray] = []
        for k, number in enumerate(ids):
            words = h[bounds[k] : bounds[k + 1]]
            if len(words) > 1:
                self.ids.append(number)
                self.words.append(len(words))
                self.sets.append(set(shingles(words, np.zeros(len(words), np.int64), 1)[0].tolist()))
                kept.append(words)
        count: dict[int, int] = {}
        for one in self.sets:
            for s in one:
                count[s] = count.get(s, 0) + 1
        self.alone = math.log1p(len(self.sets) or 1)
        self.weight = {s: math.log1p(len(self.sets) / n) for s, n in count.items()}
        self.classes = []
        by_size: dict[int, list[int]] = {}
        for k, n in enumerate(self.words):
            by_size.setdefault(_size(n), []).append(k)
        for size, members in sorted(by_size.items()):
            prints, item, at = [], [], []
            for k in members:
                starts = np.arange(len(kept[k]) - size + 1)
                prints.append(_fingerprints(_Sums(_features(kept[k]), size), size, 0, 1, len(starts)))
                item.append(np.full(len(starts), k))
                at.append(starts)
            step = max(1, min(self.words[k] - size + 1 for k in members) // 3)
            index = self._index(np.concatenate(prints), radius)
            self.classes.append((size, step, *index, np.concatenate(item), np.concatenate(at)))

    @staticmethod
    def _index(prints: np.ndarray, radius: int):
        """Fingerprints, and those with a block value within reach of each: first entry per block and value, all entries."""
        flips = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(WIDTH), n)]
        flips = np.array(flips, np.int64)
        near = ((_values(prints)[:, :, None] ^ flips) + (np.arange(BLOCKS) << WIDTH)[:, None, None]).ravel()
        owner = np.tile(np.repeat(np.arange(len(prints), dtype=np.int32), len(flips)), BLOCKS)
        first = np.zeros((BLOCKS << WIDTH) + 1, np.int32)
        np.cumsum(np.bincount(near, minlength=BLOCKS << WIDTH), out=first[1:])
        return prints, first, owner[np.argsort(near, kind="stable")]

    def search(self, h: np.ndarray, doc: np.ndarray):
        """Candidates in neighbouring texts: item, the word where it would begin, and the text."""
        found = []
        most = max(size for size, *_ in self.classes)
        for a in range(0, max(len(h) - 1, 0), _STEP):
            bits = _features(h[a : a + _STEP + most])
            sums = _Sums(bits, most)
            for size, step, prints, first, owner, item, at in self.classes:
                begin, end = -a % step, min(_STEP, len(bits) - size + 2)
                if begin >= end:
                    continue
                starts = np.arange(begin, end, step)
                mine = _fingerprints(sums, size, begin, step, len(starts))
                whole = doc[a + starts] == doc[a + starts + size - 1]
                if not whole.all():
                    starts, mine = starts[whole], mine[whole]
                value = (_values(mine) + (np.arange(BLOCKS) << WIDTH)[:, None]).ravel()
                low = first[value]
                n = first[value + 1] - low
                some = np.flatnonzero(n)
                low, n = low[some], n[some]
                which = np.repeat(some, n)
                which %= max(len(mine), 1)
                entry = owner[np.arange(len(which)) + np.repeat(low - (np.cumsum(n) - n), n)]
                close = np.flatnonzero(np.bitwise_count(mine[which] ^ prints[entry]) <= self.radius)
                if len(close):
                    which, entry = which[close], entry[close]
                    place = a + starts[which]
                    found.append(np.column_stack([item[entry], place - at[entry], doc[place]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def similarity(self, item: int, found: np.ndarray) -> float:
        """Weight of the common shingles over that of all, ``found`` being those of a stretch of text."""
        if not len(found):
            return 0.0
        mine = set(found.tolist())
        wanted = self.sets[item]
        common = sum(self.weight[s] for s in mine & wanted)
        union = sum(self.weight.get(s, self.alone) for s in mine | wanted)
        return common / union

    def hits(self, h: np.ndarray, doc: np.ndarray, n_docs: int):
        """Best place per text and item with the similarity asked for: text, item, word, words, similarity."""
        if not self.classes or not len(h):
            return []
        ends = np.cumsum(np.bincount(doc, minlength=n_docs))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        # Shingles of all words in a row; those of a stretch of five words or more are neighbours among them.
        whole = shingles(h, np.zeros(len(h), np.int64), 1)[0]
        for item, start, d in self.search(h, doc).tolist():
            # The window lies in one text; the item may stick out of it.
            low, high = (int(ends[d - 1]) if d else 0), int(ends[d])
            for shift in (0, -1, 1, -2, 2):
                a, b = max(start + shift, low), min(start + shift + self.words[item], high)
                held = whole[a : b - 4] if b - a > 4 else shingles(h[a:b], np.zeros(max(b - a, 0), np.int64), 1)[0]
                found = self.similarity(item, held)
                if found >= self.threshold and (found, -a) > best.get((d, item), (0.0, 0, 0))[:2]:
                    best[d, item] = (found, -a, b - a)
                if found == 1.0 or found < self.threshold / 2:
                    break
        return [(d, item, -a - (int(ends[d - 1]) if d else 0), n, found) for (d, item), (found, a, n) in sorted(best.items())]


def _mark(batches, rows: list[tuple[int, str]], radius: int, threshold: float, text: str, column: str):
    items = Items([r[0] for r in rows], [r[1] for r in rows], radius, threshold)
    for batch in batches:
        data, offsets = text_buffer(batch.column(text))
        found = []
        for i, j in runs(offsets, PIECE):
            doc, _, h, _, _ = tokens(data, offsets, i, j, PLAIN_WORDS)
            found += [(d + i, *rest) for d, *rest in items.hits(h, doc, j - i)]
        count = np.bincount([x[0] for x in found], minlength=batch.num_rows) if found else np.zeros(batch.num_rows, int)
        hits = [{"item_id": items.ids[item], "start": start, "n_words": n, "similarity": s} for _, item, start, n, s in found]
        kind = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
        bounds = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
        hits = pa.ListArray.from_arrays(bounds, pa.array(hits, kind))
        names = [*batch.schema.names, column]
        yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=names)


def with_benchmark_hits(
    docs: DataFrame, items: DataFrame, column: str, threshold: float = 0.8, radius: int = 11, text: str = "text"
) -> DataFrame:
    """Documents with an added array ``column`` of benchmark items found in them: item_id, start, n_words, similarity.

    Words are runs of letters and digits, A-Z read as a-z; ``start`` counts words.  Similarity is the weight of the
    common five-word shingles over that of all shingles of the item and of the stretch of text; a shingle weighs
    less the more items hold it.  An item or text of two to
    four words is one shingle; an item of one word is never found.  The best place per document and item
    counts.  Null and empty texts have no hits; items without words, or with a null text, are never found, and an
    item with a null id is found under that.  Repeated rows are searched like others; other columns stay as they are.

    The documents pass once per ``ITEMS`` items or ``CHARACTERS`` characters of the benchmark, which is the most that
    the driver and a task hold.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    n, size = asked.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    passes = max(1, -(-n // ITEMS), -(-(size or 0) // CHARACTERS))
    hits = []
    out = docs
    for k in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        rows = sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r))
        hits.append(fresh(out, f"{column}_{k}"))
        schema = StructType([*out.schema.fields, StructField(hits[-1], ArrayType(HIT))])
        out = out.mapInArrow(partial(_mark, rows=rows, radius=radius, threshold=threshold, text=text, column=hits[-1]), schema)
    return out.withColumn(column, F.concat(*hits)).drop(*[h for h in hits if h != column])


def benchmark_hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``start``, ``n_words``, ``similarity``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = with_benchmark_hits(rows, items, "hits", **options)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item is found; all columns stay."""
    column = fresh(docs, "benchmark_hits")
    found = with_benchmark_hits(docs, items, column, **options)
    return found.filter(F.size(column) == 0).select(*docs.columns)
