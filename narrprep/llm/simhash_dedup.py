"""Near-duplicate groups by SimHash fingerprints, with balls that meet in the middle.

1. Every text gets a 64-bit fingerprint from the XXH64 of its word shingles; equal fingerprints form a class.
2. Two fingerprints at most ``radius`` bits apart have a point between them that is within half the radius of both.
   Every class emits all variants of its fingerprint within half the radius, and the variants are shuffled.
3. Classes that collide under a variant are linked to one of them: the least of those that lie in the nearer half, which
   is within the radius of all others there.  The distance of every linked pair is verified, repeated pairs are dropped.
   A variant meets no more classes than its ball has points, however often a text is copied.
4. Connected components of the links.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import join_hot, runs, text_buffer, texts
from .components import components
from .hashing import LOWER, PIECE, WORDS

SEED = 42
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 17


def _joined_words(data: np.ndarray, firsts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased words of neighbouring texts with one blank behind each that a gap follows; first byte and end of each word."""
    word = WORDS[data] > 0
    begin = np.zeros(len(data) + 1, bool)
    begin[firsts] = True
    opens = word & (begin[:-1] | ~np.append(False, word[:-1]))
    closes = word & (begin[1:] | ~np.append(word[1:], False))
    kept = word | np.append(False, word[:-1])
    place = np.cumsum(kept) - 1
    plain = np.where(word, LOWER[data], 0x20)[kept].astype(np.uint8)
    return plain.tobytes(), place[opens], place[closes] + 1


def _fingerprints(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of every text of a run; zero for those without words."""
    from xxhash import xxh64_intdigest

    many = len(offsets) - 1
    out = np.zeros(many, np.uint64)
    if not len(data):
        return out
    held = offsets[:-1][offsets[:-1] < len(data)]
    plain, first, end = _joined_words(data, held)
    # Words of a text: those that begin inside it.
    word = WORDS[data] > 0
    begin = np.zeros(len(data), bool)
    begin[held] = True
    at = np.flatnonzero(word & (begin | ~np.append(False, word[:-1])))
    doc = np.searchsorted(offsets, at, "right") - 1
    count = np.bincount(doc, minlength=many)
    last = np.cumsum(count)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    ends = np.cumsum(shingles)
    ones = np.zeros((many, 64), np.int64)
    for a in range(0, int(ends[-1]), _CHUNK):
        number = np.arange(a, min(a + _CHUNK, int(ends[-1])))
        owner = np.searchsorted(ends, number, "right")
        w = last[owner] - count[owner] + number - (ends[owner] - shingles[owner])
        stop = np.minimum(w + words, last[owner]) - 1
        h = [xxh64_intdigest(plain[s:e], SEED) for s, e in zip(first[w].tolist(), end[stop].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ones[owner[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
    return packed.view("<u8").ravel().astype(np.uint64)


def _describe(batches, words: int):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        out = np.zeros(batch.num_rows, np.uint64)
        for i, j in runs(offsets, PIECE):
            out[i:j] = _fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the 64-bit SimHash of the shingles of ``words`` words, one row per row of ``docs``."""
    return texts(docs).mapInArrow(partial(_describe, words=words), "doc_id bigint, fp bigint")


def _flips(most: int) -> list[tuple[int, int]]:
    """All bit patterns with up to ``most`` bits, and their number of bits."""
    out = []
    for k in range(most + 1):
        for bits in combinations(range(64), k):
            mask = sum(1 << b for b in bits)
            out.append((mask - (1 << 64) if mask >> 63 else mask, k))
    return out


def near_links(classes: DataFrame, radius: int) -> DataFrame:
    """Links ``u``, ``v`` that span the groups of fingerprints (``fp``, distinct) at most ``radius`` bits apart."""
    flips = [F.struct(F.lit(m).alias("mask"), F.lit(k).alias("bits")) for m, k in _flips(-(-radius // 2))]
    variants = classes.select("fp", F.explode(F.array(*flips)).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip.mask")).alias("variant"), "fp", (F.col("flip.bits") > radius // 2).alias("far")
    )
    hub = "first_value(struct(far, fp)) over (partition by variant order by far, fp rows between unbounded preceding and current row)"
    met = variants.selectExpr("fp", f"{hub} as hub").filter("not hub.far and fp <> hub.fp")
    pairs = met.select(F.least("fp", "hub.fp").alias("u"), F.greatest("fp", "hub.fp").alias("v"))
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def simhash_groups(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """Fingerprint and group of every document.

    Words are runs of bytes without blanks, tabs and line ends, A-Z read as a-z; shingles are ``words`` words joined by
    blanks, repeats included (a text with fewer words is one shingle as a whole).  Bit b of a fingerprint is set if it
    is set in more than half of the shingles' XXH64 (UTF-8, seed 42).  Documents whose fingerprints differ in at most
    ``radius`` bits (0 to 4) are linked.  Returns ``doc_id``, ``fp`` (signed) and ``component_id``, the least ``doc_id``
    that can be reached over links, one row per row of ``docs``.

    A text without words (null, empty) has fingerprint zero and is linked like any other.  Repeated rows and rows that
    share an id are documents of their own.  A null id takes part, but names a group only where no member has an id
    (then the group is null).  An empty table gives an empty one; other columns are ignored.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    rows = stage(fingerprints(docs, words), "simhash-rows")
    classes = stage(
        rows.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")), "simhash-classes"
    )
    links = near_links(classes.select("fp"), radius) if radius else classes.filter("false").selectExpr("fp as u", "fp as v")
    groups = components(links, "simhash-groups").withColumnRenamed("node", "fp")
    rooted = stage(
        classes.join(groups, "fp", "left").select("fp", "doc", "copies", F.coalesce("root", "fp").alias("root")), "simhash-rooted"
    )
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("held"))
    total = rooted.agg(F.count(F.lit(1)).alias("classes"), F.sum("copies").alias("rows")).first()
    members = stage(
        join_hot(rooted, stage(least, "simhash-least"), "root", "held", total["classes"]).select("fp", "copies", "component_id"),
        "simhash-members",
    )
    return join_hot(rows, members, "fp", "copies", total["rows"] or 0).select("doc_id", "fp", "component_id")


def digest(groups: DataFrame) -> DataFrame:
    """``fingerprint`` as 16 lowercase hexadecimal digits."""
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
