"""Merkle manifest of a table: a tree of hashes per key, a tree over their roots, and a proof for every row.

1. Every row becomes a leaf.  Leaves are sorted by range partitions, written, and numbered per key from the counts of
   the written partitions; no window runs over a whole key.
2. Levels are built ``stride`` binary levels at a time: up to 2**stride neighbouring nodes are gathered in one row, the
   levels above them are folded inside the row, and what remains is a node of the next level.  A stored row stands for
   one node of a 2**stride-ary tree; it holds the levels beneath it and is linked to its parent by ``parent``.
3. A recursive query climbs from every leaf: each step joins the stored row above, appends the siblings on the way and
   folds the hash that the climb began with, until a row without parent is reached.

Rows near the top lie above very many leaves.  They are stored once per segment of neighbouring leaves, so a join key of
the climb never meets more than one segment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import broadcast_if_small

#: Binary levels that one stored row spans, and those by which a segment of leaves is larger.
STRIDE, SPREAD = 10, 4
#: Rows of starts (partition, key) that may be broadcast, 40 bytes each.
SMALL = 1_000_000
#: Stored rows of an upper level that may be broadcast, about 2**(stride + 1) digests each.
FEW = 1_000


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def digest(*values: Column) -> Column:
    """SHA-256 of the fields of all values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place inside ``tree`` by ``order`` (null first), and ``n``, the rows of the tree."""
    keys = [F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    dealt = stage(dealt, "merkle-sorted").withColumn("part", F.shiftright("mid", 33))
    counts = stage(dealt.groupBy(tree, "part").agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("held")), "merkle-counts")
    # One row per partition that holds rows of the tree.
    before = f"coalesce(sum(held) over (partition by {tree} order by part rows between unbounded preceding and 1 preceding), 0)"
    starts = counts.selectExpr(
        tree, "part", f"{before} - first as start", f"sum(held) over (partition by {tree}) as n"
    )
    starts = broadcast_if_small(starts, counts.count(), SMALL)
    return dealt.join(starts, [tree, "part"]).withColumn("pos", F.col("mid") + F.col("start")).drop("part", "mid", "start")


def _levels(width: int) -> Column:
    """Binary levels from ``nodes`` (digests in order) up: ``height`` times every two neighbours become their hash."""
    above = lambda level: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) + 1) / 2).cast("int") - 1),
        lambda i: F.unhex(
            F.sha2(F.concat(F.lower(F.hex(F.get(level, i * 2))), F.coalesce(F.lower(F.hex(F.get(level, i * 2 + 1))), F.lit(""))), 256)
        ),
    )
    return F.aggregate(
        F.slice(F.array(*[F.lit(k) for k in range(width)]), F.lit(1), F.col("height")),
        F.array("nodes"),
        lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))),
    )


def _spread(stride: int) -> int:
    return min(SPREAD, stride)


def _bits(n: Column) -> Column:
    """Binary levels over ``n`` nodes."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def build_levels(nodes: DataFrame, stride: int = STRIDE) -> tuple[list[DataFrame], DataFrame]:
    """Stored rows of every level of the trees over ``nodes`` (``tree``, ``pos``, ``digest``, ``n``), and their roots.

    A stored row holds ``tree``, ``block`` (its place in the level), ``n`` (nodes of the tree beneath), ``height`` (binary
    levels it spans) and ``levels``.  Its parent is the row of the next level with ``block`` >> ``stride``.
    """
    stored, tops = [], []
    while True:
        blocks = (
            nodes.groupBy("tree", F.shiftright("pos", stride).alias("block"))
            .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("nodes"))
            .withColumn("height", F.least(_bits(F.col("n")), F.lit(stride)).cast("int"))
        )
        rows = stage(blocks.select("tree", "block", "n", "height", _levels(stride).alias("levels")), "merkle-level")
        stored.append(rows)
        top = F.col("levels")[F.col("height")][0].alias("digest")
        tops.append(rows.filter(F.col("n") <= 1 << stride).select("tree", top))
        above = rows.filter(F.col("n") > 1 << stride)
        if above.isEmpty():
            return stored, reduce(DataFrame.unionByName, tops)
        nodes = above.select("tree", F.col("block").alias("pos"), top, F.shiftright(F.col("n") - 1, stride).alias("m"))
        nodes = nodes.select("tree", "pos", "digest", (F.col("m") + 1).alias("n"))


def _climbed(stored: list[DataFrame], over: list[DataFrame], stride: int) -> DataFrame:
    """Stored rows as the climb meets them: one per tree, step and segment of leaves.

    ``parent`` is the next step, null at the root.  ``by_tree`` says that the place is that of the tree among all
    trees and not that of the leaf; ``shift`` leads from it to the place inside the level.
    """
    spread = _spread(stride)
    path = F.when(F.col("height") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col("height") - 1))
    whole = F.col("n") <= 1 << stride
    #: Steps to the top row of the own tree.
    last = F.greatest(F.ceil(_bits(F.col("n")) / stride) - 1, F.lit(0)).cast("int")
    segments = stage(
        stored[0].filter(F.col("block") % (1 << spread) == 0).select(
            "tree", F.shiftright("block", spread).alias("segment"), last.alias("last")
        ),
        "merkle-segments",
    )

    def met(rows: DataFrame, step: Column, parent: Column, by_tree: bool, shift: int, ends: Column, top: bool) -> DataFrame:
        return rows.select(
            "tree", step.alias("step"), "segment", parent.alias("parent"), F.lit(by_tree).alias("by_tree"),
            F.lit(shift).alias("shift"), path.alias("path"), "levels", ends.alias("ends"), F.lit(top).alias("top"),
        )

    # The lowest level has one stored row per segment of its own size.
    rows = [met(stored[0].withColumnRenamed("block", "segment"), F.lit(0), F.lit(1), False, 0, whole, False)]
    for k, level in enumerate(stored[1:], 1):
        here = segments.filter(F.col("last") >= k).withColumn("block", F.shiftright("segment", stride * k - spread))
        here = here.join(broadcast_if_small(level, level.count(), FEW), ["tree", "block"])
        rows.append(met(here, F.lit(k), F.lit(k + 1), False, stride * k, whole, False))
    for k, level in enumerate(over):
        # Trees are the leaves of the tree over them.
        here = segments.withColumn("block", F.shiftright("tree", stride * (k + 1)))
        here = here.join(broadcast_if_small(level.drop("tree"), level.count(), FEW), "block")
        step = F.col("last") + 1 + k
        parent = step + 1 if k + 1 < len(over) else F.lit(None).cast("int")
        rows.append(met(here, step, parent, True, stride * k, F.lit(False), k + 1 == len(over)))
    return stage(reduce(DataFrame.unionByName, rows), "merkle-nodes")


#: Place of a climbing leaf in binary level k of a stored row.
AT = "cast(shiftright(if(n.by_tree, c.tree, c.pos), n.shift + k) & shiftright({mask}, k) as int)"
CLIMB = """
with recursive climb(tree, pos, doc_id, leaf, step, segment, hash, proof, subroot, root) as (
    select tree, pos, doc_id, leaf, 0, shiftright(pos, {stride}), started, X'', cast(null as binary), cast(null as binary)
    from {leaves}
    union all
    select c.tree, c.pos, c.doc_id, c.leaf, n.parent, shiftright(c.pos, {segment_bits}),
        aggregate(n.path, c.hash, (h, k) -> unhex(sha2(if({at} % 2 = 0,
            concat(lower(hex(h)), coalesce(lower(hex(get(n.levels[k], {at} + 1))), '')),
            concat(lower(hex(get(n.levels[k], {at} - 1))), lower(hex(h)))), 256))),
        concat(c.proof, aggregate(n.path, X'', (p, k) -> concat(p, coalesce(get(n.levels[k], {at} ^ 1), X'')))),
        if(n.ends, n.levels[size(n.path)][0], c.subroot),
        if(n.top, n.levels[size(n.path)][0], c.root)
    from climb c join {nodes} n on c.tree = n.tree and c.step = n.step and c.segment = n.segment
)
select doc_id, leaf, subroot, root, proof, hash from climb where root is not null limit all
"""


def merkle_manifest(
    docs: DataFrame,
    leaf: Column,
    started: Column | None = None,
    tree: str = "lang",
    order: str = "doc_id",
    stride: int = STRIDE,
) -> DataFrame:
    """Manifest of a table: one row per row of ``docs`` with its proof, and the root that its hash folds to.

    ``leaf`` is the 32-byte hash of a row, ``started`` the hash that its climb begins with (the leaf itself by default).
    Rows of equal ``tree`` value make a tree, leaves rising by ``order``; while several nodes remain, every two
    neighbours (the last one alone, if their number is odd) become the hash of their hexadecimal digests.  Roots of the
    trees, by tree value, make the leaves of the tree over them.

    Returns ``doc_id`` (the order column), ``leaf``, ``subroot`` (root of the own tree), ``root``, ``proof`` (siblings
    from the leaf up, 32 bytes each) and ``folded`` (what ``started`` folds to with these siblings), all binary.

    A null tree value is a tree of its own and comes first; strings compare by their UTF-8 bytes.  Null order values
    come first; ties are ordered by the leaf, so rows equal in all hashed fields are leaves side by side.  A tree of one
    row has its leaf as root and nothing to prove; a table of one tree has the root of that tree.  An empty table gives
    an empty one.  Only the columns named by the arguments are read, so others cannot clash.
    """
    rows = docs.select(
        F.col(tree).alias("kind"), F.col(order).cast("bigint").alias("doc_id"), leaf.alias("leaf"),
        (leaf if started is None else started).alias("started"),
    )
    rows = stage(rows, "merkle-leaves")
    kinds = _numbered(rows.select("kind").distinct().withColumn("all", F.lit(0)), "all", ["kind"])
    kinds = stage(kinds.select("kind", F.col("pos").alias("tree")), "merkle-trees")
    small = broadcast_if_small(kinds.withColumnRenamed("kind", "k"), n_trees := kinds.count(), SMALL)
    ranked = rows.join(small, rows["kind"].eqNullSafe(F.col("k"))).drop("kind", "k")
    leaves = _numbered(ranked, "tree", ["doc_id", "leaf"])
    leaves = stage(leaves, "merkle-numbered")
    stored, tops = build_levels(leaves.select("tree", "pos", F.col("leaf").alias("digest"), "n"), stride)
    over, _ = build_levels(
        tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_trees).cast("bigint").alias("n")),
        stride,
    )
    nodes = _climbed(stored, over, stride)
    # The engine's own bound on rows does not apply: LIMIT ALL lifts it; steps are few, as each spans ``stride`` levels.
    return docs.sparkSession.sql(
        CLIMB.replace("{at}", AT)
        .replace("{stride}", str(stride))
        .replace("{segment_bits}", str(stride + _spread(stride)))
        .replace("{mask}", str((1 << stride) - 1)),
        leaves=leaves.select("tree", "pos", "doc_id", "leaf", "started"),
        nodes=nodes,
    ).withColumnRenamed("hash", "folded")


def document_leaf(n_chars: Column) -> Column:
    return digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))


def documents_manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Manifest of ``documents`` where some rows are tampered with: those with 7 dividing the CRC of their id.

    Tampering adds 1 to ``n_chars`` (a null stays); a null id is never tampered with.  Digests are lowercase hex.
    """
    n_chars = F.col("n_chars").cast("bigint")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = (n_chars.cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    started = F.when(hit, document_leaf(more)).otherwise(document_leaf(n_chars))
    found = merkle_manifest(docs, document_leaf(n_chars), started, stride=stride)
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def manifest_sql() -> str:
    """The manifest of ``documents`` as SQL: binary levels one by one, a climb from every leaf."""
    part = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    whole = lambda n: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", n, "text"))) + ")"
    return f"""
with recursive marked as (
    select *, case when doc_id is null then 1 else xor(list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord(substr(doc_id::varchar, i, 1))::bigint)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 7 end as rest
    from documents
), hashed as (
    select doc_id, lang, {whole("n_chars")} as leaf, case when rest = 0 then {whole("(n_chars + 1)")} else {whole("n_chars")} end as started
    from marked
), leaves as (
    select *, dense_rank() over (order by lang nulls first) as tree,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n
    from hashed
), nodes as (
    select tree, 0 as lvl, pos, leaf as h, n from leaves
    union all
    select tree, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from nodes where n > 1
    group by tree, lvl, pos // 2, n
), subroots as (
    select tree, h, count(*) over () as n from nodes where n = 1
), tops as (
    select 0 as lvl, tree - 1 as pos, h, n from subroots
    union all
    select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from tops where n > 1 group by lvl, pos // 2, n
), climb as (
    select tree, pos as leaf_pos, 0 as lvl, pos, n, started as h, '' as proof from leaves
    union all
    select c.tree, leaf_pos, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
        case when s.h is null then sha256(c.h) when c.pos % 2 = 0 then sha256(c.h || s.h) else sha256(s.h || c.h) end,
        proof || coalesce(s.h, '')
    from climb c left join nodes s on s.tree = c.tree and s.lvl = c.lvl and s.pos = xor(c.pos, 1) where c.n > 1
), high as (
    select tree, leaf_pos, 0 as lvl, tree - 1 as pos, (select count(*) from subroots) as n, h, proof from climb where n = 1
    union all
    select c.tree, leaf_pos, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
        case when s.h is null then sha256(c.h) when c.pos % 2 = 0 then sha256(c.h || s.h) else sha256(s.h || c.h) end,
        proof || coalesce(s.h, '')
    from high c left join tops s on s.lvl = c.lvl and s.pos = xor(c.pos, 1) where c.n > 1
)
select doc_id, leaf, subroots.h as subroot, tops.h as root, sha256(high.proof) as proof_sha256, high.h as folded_root,
    high.h = tops.h as verified
from leaves join subroots using (tree) join high on high.tree = leaves.tree and high.leaf_pos = leaves.pos and high.n = 1
    cross join tops where tops.n = 1
"""
