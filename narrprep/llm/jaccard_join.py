"""Groups of documents whose sets of word shingles are alike, by exact T-occurrence search.

1. Documents with equal shingle sets form a class; only classes are compared.
2. Shingles are put in one order for all classes, and a class is entered under the first few only, so that any two
   classes that are similar enough meet under at least one.  A quarter of all shingles (by hash) stands in front,
   rare ones first; a shingle that one class alone holds is entered but never met.  Classes that meet nobody are
   done, which are nearly all of ordinary text.
3. Classes of like set size that meet one class under their entries form a neighbourhood; a class may lie in several.
   Neighbourhoods are dealt into blocks of bounded size; a large one is cut into parts, and every two parts make a block.
4. In a block an inverted index over whole shingle sets is searched with DivideSkip: for a class with threshold T
   the L longest lists are left aside, the short ones are merged by counting, classes with T - L hits are looked up
   in the long lists by binary search, and what reaches the exact overlap is a link.  Classes that are linked
   already are not looked up again, so a group of many near copies costs one link each.
5. Connected components of the links.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_lists, broadcast_if_small, join_hot, runs, text_buffer, texts
from .components import components
from .hashing import PIECE, WORDS, mix, shingles, signed, tokens

#: Part of all shingles that stand in front of the common order.
FRONT = 0.25
#: Rows of class numbers that may be broadcast to the texts, 16 bytes each.
SMALL = 1_000_000
_TURN = np.uint64(0x94D049BB133111EB)


def _sets(batch, text: str, words: int, salt: int):
    """For neighbouring texts taken together: first text, number of texts, sorted shingles and their text."""
    data, offsets = text_buffer(batch.column(text))
    for i, j in runs(offsets, PIECE):
        doc, _, h, _, _ = tokens(data, offsets, i, j, WORDS)
        t, d = shingles(h, doc, j - i, words)
        t = mix(t + np.uint64(salt) * _TURN)
        order = np.lexsort((t, d))
        t, d = t[order], d[order]
        new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])) if len(t) else np.zeros(0, bool)
        yield i, j - i, t[new], d[new]


def _class(t, d, n_docs):
    """Size of every set and two hashes of it that do not depend on the order."""
    n = np.bincount(d, minlength=n_docs)
    ends = np.cumsum(n)
    total = [np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64)) for x in (mix(t * _TURN), mix(t ^ _TURN))]
    first, second = (mix((x[ends] - x[ends - n]) + n.astype(np.uint64)) for x in total)
    return n, first, second


def _entered(t, d, n, percent: int):
    """Which shingles a set is entered under: all in front, or as many as its prefix needs if those are fewer."""
    front = (mix(t ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) < np.uint64(int(FRONT * 2**32))
    count = np.bincount(d[front], minlength=len(n))
    need = np.maximum(count, n - (percent * n + 99) // 100 + 1) * (n > 0)
    order = np.lexsort((t, ~front, d))
    starts = np.cumsum(n) - n
    rank = np.arange(len(t)) - starts[d]
    return order[rank < need[d]], need


def _describe(batches, words: int, percent: int, salt: int):
    """Size and hashes of every set, and the shingles it is entered under; of equal sets of a batch one lists them."""
    for batch in batches:
        out = [np.zeros(batch.num_rows, np.int64) for _ in range(5)]
        entered, seen = [np.zeros(0, np.uint64)], set()
        for i, k, t, d in _sets(batch, "text", words, salt):
            n, first, second = _class(t, d, k)
            at, need = _entered(t, d, n, percent)
            new = np.array([x not in seen and not seen.add(x) for x in first.tolist()], bool) & (n > 0)
            at = at[new[d[at]]]
            entered.append(t[at])
            listed = np.bincount(d[at], minlength=k)
            for column, value in zip(out, (n, signed(first), signed(second), need, listed), strict=True):
                column[i : i + k] = value
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_text"), *map(pa.array, out[:4]),
             arrow_lists(signed(np.concatenate(entered)), out[4], pa.int64())],
            names=["doc_id", "row_text", "n", "c", "c2", "entered", "t"],
        )


def _whole(batches, words: int, salt: int):
    for batch in batches:
        for _, k, t, d in _sets(batch, "text", words, salt):
            n, first, _ = _class(t, d, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(first)), arrow_lists(signed(t), n, pa.int64())], names=["c", "shingles"]
            )


def divide_skip(shingle: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Links that span the groups of similar sets: pairs of set numbers.

    ``shingle`` holds the sets one after the other, distinct within a set; ``sizes`` rises.  Two sets are similar
    if 100 * common >= percent * union.  Sets without elements are similar to none.
    """
    many = len(sizes)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(many), sizes)
    # One list per shingle, owners rising; lists of one owner are left out.
    _, number = np.unique(shingle, return_inverse=True)
    order = np.lexsort((owner, number))
    shared = np.bincount(number)[number[order]] > 1
    order = order[shared]
    lists, owners = number[order], owner[order]
    place = np.full(len(shingle), -1)
    place[order] = np.arange(len(order))
    # A set looks at lists from the first owner large enough to itself.
    need = (percent * sizes + 99) // 100
    lowest = np.searchsorted(sizes, need, "left")
    begin = np.searchsorted(lists * many + owners, lists * many + lowest[owners], "left")
    width = np.arange(len(order)) - begin
    reached = np.bincount(owners, weights=width > 0, minlength=many)

    root = np.arange(many)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x in np.flatnonzero((reached >= need) & (sizes > 0)).tolist():
        mine = place[ends[x] - sizes[x] : ends[x]]
        mine = mine[mine >= 0]
        mine = mine[width[mine] > 0]
        mine = mine[np.argsort(-width[mine], kind="stable")]
        a, b = begin[mine], mine
        least = int(need[x])
        longest = int(width[mine[0]])
        aside = min(int(least / (0.0085 * np.log2(longest + 1) + 1)), least - 1, len(mine))
        low = int(lowest[x])
        short = [owners[s:e] for s, e in zip(a[aside:].tolist(), b[aside:].tolist(), strict=True)]
        if not short:
            continue
        hits = np.bincount(np.concatenate(short) - low, minlength=1)
        found = np.flatnonzero(hits >= least - aside)
        if not len(found):
            continue
        found = found[np.argsort(-hits[found], kind="stable")]
        step, at = 1, 0
        top = find(x)
        while at < len(found):
            tried = found[at : at + step]
            at, step = at + step, min(step * 2, 4096)
            tried = tried[[find(y) != top for y in (tried + low).tolist()]]
            if not len(tried):
                continue
            common = hits[tried].copy()
            y = tried + low
            for s, e in zip(a[:aside].tolist(), b[:aside].tolist(), strict=True):
                part = owners[s:e]
                where = np.searchsorted(part, y)
                common += part[np.minimum(where, len(part) - 1)] == y
            union = sizes[y] + sizes[x] - common
            for other in y[100 * common >= percent * union].tolist():
                other_top = find(other)
                if other_top != top:
                    links.append((x, other))
                    root[max(top, other_top)] = min(top, other_top)
                    top = min(top, other_top)
    return np.array(links, np.int64).reshape(-1, 2)


def _search_block(table: pa.Table, percent: int) -> pa.Table:
    table = table.combine_chunks()
    c = np.asarray(table.column("c"))
    _, one = np.unique(c, return_index=True)
    lists = table.column("shingles").combine_chunks() if table.num_rows else None
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, bounds = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    one = one[np.argsort(sizes[one], kind="stable")]
    parts = [flat[bounds[k] : bounds[k + 1]] for k in one.tolist()]
    links = divide_skip(np.concatenate(parts), sizes[one], percent)
    names = c[one]
    return pa.table({"u": names[links[:, 0]], "v": names[links[:, 1]]})


def _size_band(n: Column, percent: int) -> Column:
    """Sizes of two similar sets lie in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def _neighbourhoods(entries: DataFrame) -> DataFrame:
    """Classes (``node``) with the neighbourhoods (``root``) they lie in; classes that meet nobody are left out.

    A list holds the classes entered under one shingle in one size band, and its head is the least of them.  A class
    lies in the neighbourhoods of the heads of its own lists and of the lists one band above, so any two classes that
    meet share the head of one list.  Nothing is followed further: a chain of classes, each of which meets the next,
    has neighbourhoods of a few classes.  One that lies within the neighbourhood that its head has elsewhere is left out.
    """
    next_band = Window.partitionBy("t").orderBy("band")
    lists = entries.groupBy("t", "band").agg(F.min("c").alias("head"), F.count(F.lit(1)).alias("held")).withColumn(
        "above", F.when(F.lead("band").over(next_band) == F.col("band") + 1, F.lead("head").over(next_band))
    )
    lists = stage(lists, "jaccard-lists")
    met = join_hot(entries, lists, ["t", "band"], "held", lists.agg(F.sum("held")).first()[0] or 0)
    heads = F.array_compact(F.array("head", "above"))
    cells = stage(met.select(F.col("c").alias("node"), F.explode(heads).alias("root")).distinct(), "jaccard-reach")
    total = cells.count()

    # A head names only neighbourhoods of heads below it, so leaving out goes on to one that stays.
    into = cells.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("into")).filter("into < root")
    roots = cells.groupBy("root").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").join(into, "root", "left")
    roots = stage(roots, "jaccard-roots")
    elsewhere = cells.withColumnRenamed("root", "into")
    within = join_hot(cells, roots.filter("into is not null"), "root", "held", total).join(elsewhere, ["node", "into"])
    within = within.groupBy("root").agg(F.count(F.lit(1)).alias("within"))
    kept = stage(roots.join(within, "root", "left").filter("within is null or within < held"), "jaccard-kept")
    return join_hot(cells, kept, "root", "held", total).select("node", "root")


def jaccard_join(docs: DataFrame, percent: int = 80, words: int = 5, block: int = 1_500_000) -> DataFrame:
    """Shingle-set size and group of every document.

    Words are runs of bytes without blanks, tabs and line ends, A-Z read as a-z.  Two documents are linked if
    100 * common shingles >= ``percent`` * shingles of both.  Returns ``doc_id``, ``row_text`` (hash of the text),
    ``n_shingles`` and ``component_id``, the least ``doc_id`` that can be reached over links, the own included;
    one row per row of ``docs``.

    A text of one to ``words`` - 1 words is one shingle as a whole; a text without words (null, empty) has no
    shingle, is linked with nothing and keeps its own id.  Repeated rows and rows that share an id are documents of
    their own and fall into one group if their texts are alike.  A null id takes part but names a group only where
    no member has an id (then the group is null).  An empty table gives an empty one; other columns are ignored.

    ``block`` bounds the shingles that one task indexes at a time (one larger set stands alone).
    """
    return _grouped(docs, percent, words, block).drop("root")


def _grouped(docs: DataFrame, percent: int = 80, words: int = 5, block: int = 1_500_000) -> DataFrame:
    """``jaccard_join`` with ``root``, the class that names the group of a row; null where there are no words."""
    rows = texts(docs).withColumn("row_text", F.xxhash64("text"))
    salt = 0
    while True:
        sets = stage(
            rows.mapInArrow(
                partial(_describe, words=words, percent=percent, salt=salt),
                "doc_id bigint, row_text bigint, n bigint, c bigint, c2 bigint, entered bigint, t array<bigint>",
            ),
            "jaccard-sets",
        )
        classes = sets.filter("n > 0").groupBy("c").agg(
            F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.min("entered").alias("entered"),
            F.min("c2").alias("least"), F.max("c2").alias("most"), F.count(F.lit(1)).alias("copies"), F.max("t").alias("t"),
        )
        classes = stage(classes, "jaccard-classes")
        # Two different sets with one hash: all hashes are taken anew.
        if classes.filter("least <> most").isEmpty():
            break
        salt += 1

    every = classes.select("c", F.explode("t").alias("t"))
    met = every.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = stage(met, "jaccard-met")
    # Every class has its own row for a shingle; those of one shingle that most classes hold are not gathered.
    counted = join_hot(every, met, "t", "df", met.agg(F.sum("df")).first()[0] or 0)
    held = counted.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("met"))
    need = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    prefix = held.join(classes.select("c", "n", "entered"), "c").withColumn(
        "keep", (need - F.col("entered") + F.size("met")).cast("int")
    )
    entries = stage(
        prefix.filter("keep > 0").select(
            "c", _size_band(F.col("n"), percent).alias("band"), F.explode(F.slice("met", F.lit(1), F.col("keep"))["t"]).alias("t")
        ),
        "jaccard-entries",
    )

    near = stage(_neighbourhoods(entries).join(classes.withColumnRenamed("c", "node").select("node", "n"), "node"), "jaccard-near")
    weights = stage(near.groupBy("root").agg(F.sum("n").alias("weight")), "jaccard-weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    bins = max(1, -(-2 * total // block))
    parts = F.ceil(F.col("weight") * 2 / F.lit(block)).cast("int")
    cells = near.join(weights.withColumn("parts", parts), "root").withColumn(
        "part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts").cast("bigint")).cast("int")
    )
    steps = F.sequence(F.lit(0), F.col("parts") - 1)
    few = cells.filter("parts = 1").select(
        F.col("node").alias("c"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("hood"), F.lit(-1).alias("i"), F.lit(-1).alias("j")
    )
    many = cells.filter("parts > 1").select("node", "root", "part", F.explode(steps).alias("other")).select(
        F.col("node").alias("c"), F.col("root").alias("hood"),
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
    )
    cells = stage(few.distinct().unionByName(many), "jaccard-cells")

    wanted = near.select(F.col("node").alias("c")).distinct()
    wanted = stage(wanted.join(classes, "c").select("c", "doc"), "jaccard-wanted")
    size = wanted.count()
    only = broadcast_if_small(wanted.select("doc").distinct(), size, SMALL)
    found = rows.join(only, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("text")
    whole = found.mapInArrow(partial(_whole, words=words, salt=salt), "c bigint, shingles array<bigint>")
    links = (
        whole.join(cells, "c")
        .groupBy("hood", "i", "j")
        .applyInArrow(lambda table: _search_block(table, percent), "u bigint, v bigint")
    )
    groups = components(links, "jaccard-groups").withColumnRenamed("node", "c")
    rooted = classes.select("c", "doc", "copies").join(groups, "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = stage(rooted, "jaccard-rooted")
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("held"))
    total = rooted.agg(F.count(F.lit(1)).alias("classes"), F.sum("copies").alias("rows")).first()
    member = join_hot(rooted, stage(least, "jaccard-least"), "root", "held", total["classes"])
    member = stage(member.select("c", "copies", "root", "component_id"), "jaccard-members")
    columns = ["doc_id", "row_text", F.col("n").alias("n_shingles"), "component_id", "root"]
    joined = join_hot(sets.filter("n > 0").drop("t"), member, "c", "copies", total["rows"] or 0).select(*columns)
    alone = sets.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("bigint")})
    return joined.unionByName(alone.select(*columns))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, the one with the least id, all columns; of equal rows one stays.

    Documents without words stay.  Groups are told apart by their texts, so two groups that share their least id both
    keep a document, and a group without any id keeps one.
    """
    found = stage(_grouped(docs, **options), "jaccard-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_text")
    heads = found.filter("n_shingles > 0").groupBy("root").agg(F.min(order).alias("head"))
    heads = heads.select("head.doc_id", "head.row_text")
    empty = found.filter("n_shingles = 0").select("doc_id", "row_text").distinct()
    copies = found.groupBy("doc_id", "row_text").agg(F.count(F.lit(1)).alias("copies"))
    keep = heads.unionByName(empty).alias("k").join(
        copies.alias("c"),
        F.expr("k.doc_id <=> c.doc_id and k.row_text = c.row_text"),
    ).select(F.col("k.doc_id").alias("jaccard_doc"), F.col("k.row_text").alias("jaccard_text"), "copies")
    keep = stage(keep, "jaccard-keep")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    match = docs["doc_id"].cast("bigint").eqNullSafe(keep["jaccard_doc"]) & (text == keep["jaccard_text"])
    out = docs.join(keep.filter("copies = 1"), match, "left_semi")
    again = keep.filter("copies > 1")
    if again.isEmpty():
        return out
    repeated = docs.withColumn(key := "jaccard_text_key", text).join(
        again, F.expr("cast(doc_id as bigint) <=> jaccard_doc and jaccard_text_key = jaccard_text"), "left_semi"
    )
    return out.unionByName(repeated.dropDuplicates(["doc_id", key]).drop(key))
