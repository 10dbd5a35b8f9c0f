"""Merkle manifest, whitening and SimHash groups against brute force."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from narrprep.llm import queries as Q
from narrprep.llm.components import components
from narrprep.llm.merkle import documents_manifest, merkle_manifest
from narrprep.llm.simhash_dedup import digest, near_links, simhash_groups
from narrprep.llm.whitening import whiten

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASH = ", pos bigint, n string, tree string, fp string, leaf string, kind int, step string, hash string, variant int, key string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", 2, "e", "f", 3, "g") for r in rows], DOCS + CLASH)


def by_rows(rows):
    return collections.Counter(map(repr, rows))


# --- manifest ---------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, source, lang, n, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes, at):
    """Root of the nodes, and (siblings, whether they stand in front) on the way of node ``at``."""
    way = []
    while len(nodes) > 1:
        way.append((nodes[at ^ 1] if at ^ 1 < len(nodes) else "", at % 2 == 1))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at //= 2
    return nodes[0], way


def manifest(rows):
    hashed = []
    for doc, text, lang, source, n in rows:
        leaf = leaf_of(doc, source, lang, n, text)
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        hashed.append((lang, doc, leaf, leaf_of(doc, source, lang, n + 1 if n is not None and hit else n, text)))
    trees = collections.defaultdict(list)
    for row in hashed:
        trees[row[0]].append(row)
    kinds = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for kind in kinds:
        trees[kind].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    subroots = [climb([r[2] for r in trees[k]], 0)[0] for k in kinds]
    out = []
    for place, kind in enumerate(kinds):
        leaves = [r[2] for r in trees[kind]]
        root, high = climb(subroots, place)
        for at, (_, doc, leaf, started) in enumerate(trees[kind]):
            way = climb(leaves, at)[1] + high
            # A lone node is hashed by itself: its sibling is empty.
            folded = started
            for sibling, front in way:
                folded = H(sibling, folded) if front else H(folded, sibling)
            out.append((doc, leaf, subroots[place], root, H(*(s for s, _ in way)), folded, folded == root))
    return out


def shown(df):
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return by_rows(tuple(r[c] for c in names) for r in df.collect())


def some_documents(n, seed=1):
    rng = random.Random(seed)
    # One tree holds a third of all rows and more.
    kinds = ["en"] * 4 + ["de", None, "é", "zz", ""]
    rows = [(d, f"text {d} é", rng.choice(kinds), rng.choice(["a", None]), rng.choice([d, None])) for d in range(n)]
    return rows


def test_manifest(spark):
    rows = some_documents(300)
    rows += [rows[5], rows[5], (None, None, None, None, None), (None, "x", "en", None, 1), (None, "x", "en", None, 1)]
    rows += [(7, "other", "en", "a", 9), (900, "", "alone", "", 0), (901, "x" * 300_000, "de", "s", 2**63 - 1)]
    random.Random(2).shuffle(rows)
    want = by_rows(manifest(rows))
    # Small strides make several stored levels in both trees.
    for stride in (2, 10):
        assert shown(documents_manifest(documents(spark, rows), stride)) == want
    tampered = [r for r in manifest(rows) if not r[-1]]
    assert tampered and len(tampered) < len(rows) / 3


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9])
def test_manifest_of_few_rows(spark, n):
    kinds = ["en"] if n % 2 else ["en", None, "de"]
    rows = [(d, f"t{d}", kinds[d % len(kinds)], "s", d) for d in range(n)]
    assert shown(documents_manifest(documents(spark, rows), 1)) == by_rows(manifest(rows))


def test_manifest_of_many_trees(spark):
    rows = [(d, "t", f"kind {d % 70}", "s", d) for d in range(150)]
    assert shown(documents_manifest(documents(spark, rows), 3)) == by_rows(manifest(rows))


def test_manifest_equals_sql(spark, tmp_path):
    rows = some_documents(120, 4) + [(None, None, None, None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{path}/*.parquet'")
    found = duck.execute(Q.ORACLE["op11_merkle_manifest"])
    columns = [c[0] for c in found.description]
    got = Q.op11_merkle_manifest(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    assert by_rows(map(tuple, got.select(*columns).collect())) == by_rows(found.fetchall())


def test_manifest_of_any_table(spark):
    rows = spark.createDataFrame([("x", 3, "p"), ("x", 1, "q"), ("y", 2, "r")], "kind string, place int, what string")
    got = merkle_manifest(rows, F.unhex(F.sha2("what", 256)), tree="kind", order="place").collect()
    p, q, r = (hashlib.sha256(c.encode()).hexdigest() for c in "pqr")
    assert {x["root"].hex() for x in got} == {H(H(q, p), r)} == {x["folded"].hex() for x in got}
    assert {x["doc_id"]: x["proof"].hex() for x in got} == {3: q + r, 1: p + r, 2: H(q, p)}


# --- whitening --------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(
        [(k, v, 1, "a", 2.0) for k, v in rows], "vec_id bigint, embedding array<float>, n int, key string, whitened double"
    )


def fraction_covariance(x):
    n, d = len(x), len(x[0])
    means = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return np.array([[float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def check_whitening(got, rows, most=32):
    """``got`` against covariances in exact fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    matrix = fraction_covariance(x)
    values, components = np.linalg.eigh(matrix)
    values, components = values[::-1], components[:, ::-1]
    k = min(most, int((values > d * np.finfo(float).eps * values[0]).sum()))
    assert len(got) == n * k
    deviation = collections.Counter((key, sum((n * c - s) ** 2 for c, s in zip(r, sums))) for (key, _), r in zip(rows, x))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got if r["identity_error"] > 1e-8} == set()
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    want = centred @ components[:, :k] / np.sqrt(values[:k])
    where = {key: at for at, (key, _) in enumerate(rows)}
    table = np.zeros((n, k))
    for r in got:
        table[where[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert math.isclose(r["explained"], values[r["component"] - 1] / np.trace(matrix), rel_tol=1e-9)
    signs = np.sign((table * want).sum(0))
    assert np.abs(table * signs - want).max() < 1e-6


def test_whitening(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    rows = [(k, (rng.normal(size=6) @ mix + 3).tolist()) for k in range(200)]
    bad = [(500, None), (501, [1.0, None] + [0.0] * 4), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, []), (505, [1.0, 2.0])]
    got = whiten(vectors(spark, rows + bad)).collect()
    check_whitening(got, rows)
    check_whitening(whiten(vectors(spark, rows), most=2).collect(), rows, 2)


def test_whitening_of_large_values(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=3) * 1e4).tolist()) for k in range(60)]
    check_whitening(whiten(vectors(spark, rows)).collect(), rows)
    # Deviations beyond 64 bits are null.
    huge = [(k, [float(k) * 1e9, -1e8 * k * k]) for k in range(40)]
    got = whiten(vectors(spark, huge)).collect()
    assert len(got) == 80 and {r["deviation"] for r in got} == {None}


def test_whitening_without_variance(spark):
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    # Two of three dimensions depend on each other; repeated rows and a null id stay.
    rows = [(k, [float(k), 2.0 * k, float(k % 3)]) for k in range(30)] + [(3, [3.0, 6.0, 0.0]), (None, [1.0, 2.0, 1.0])]
    got = whiten(vectors(spark, rows)).collect()
    assert len(got) == 2 * len(rows) and max(r["component"] for r in got) == 2
    assert sum(r["vec_id"] == 3 for r in got) == 4 and sum(r["vec_id"] is None for r in got) == 2


def test_registered_whitening(spark, small):
    got = Q.op12_embedding_whitening(spark, small).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_whitening(got, rows)


# --- fingerprints -----------------------------------------------------------

GAPS = " \t\n\x0b\x0c\r"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low:
        if c in GAPS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def fingerprint(text, size=3):
    w = words_of(text)
    shingles = [" ".join(w[k : k + size]) for k in range(max(len(w) - size + 1, min(1, len(w))))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, prints, radius):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_groups(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(200, 400))) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(6, 60):
        parts = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            parts[rng.randrange(len(parts))] = f"X{rng.randrange(99)}é"
        rows.append((k, rng.choice(GAPS).join(parts)))
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "one"), (64, "One  two"), (65, "one\ttwo"), (66, "a b c"), (None, base[0])]
    rows += [rows[0], rows[0], (2, base[4]), (67, "x" * 700_000 + " y " + "z " * 200_000), (None, "lonely words that nobody else has")]
    prints = [fingerprint(t) for _, t in rows]
    table = documents(spark, [(d, t, None, None, None) for d, t in rows])
    for radius in (0, 1, 2, 3):
        want = grouped([d for d, _ in rows], prints, radius)
        got = digest(simhash_groups(table, radius)).collect()
        assert by_rows((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == by_rows(
            (d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want)
        )
    assert simhash_groups(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash_groups(table, 5)


def test_registered_fingerprints(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    prints = [fingerprint(t) for _, t in docs]
    want = grouped([d for d, _ in docs], prints, 2)
    got = Q.op13_simhash_dedup(spark, small).collect()
    assert by_rows((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == by_rows(
        (d, f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, want)
    )


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_all_links_within_the_radius_are_kept(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = set(centres)
    for _ in range(60):
        c = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 5)):
            c ^= 1 << rng.randrange(64)
        prints.add(c)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), radius).collect()
    number = {p: k for k, p in enumerate(signed)}
    assert all(bin(prints[number[x["u"]]] ^ prints[number[x["v"]]]).count("1") <= radius for x in links)
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in links:
        a, b = find(number[x["u"]]), find(number[x["v"]])
        root[max(a, b)] = min(a, b)
    assert [find(k) for k in range(len(prints))] == grouped(list(range(len(prints))), prints, radius)


def test_components_of_a_hub(spark):
    # A hub above the bound of join_hot, a long path that ends in it, and pairs of their own.
    rows = [(0, k) for k in range(1, 4000)] + [(k, k + 1) for k in range(4000, 4040)] + [(4040, 3999)]
    rows += [(k, k + 1) for k in range(10_000, 12_000, 2)] + [(5, 5), (None, 3), (0, 1)]
    got = components(spark.createDataFrame(rows, "u bigint, v bigint"), "test-hub").collect()
    want = {k: 0 for k in range(4041)} | {k: k - k % 2 for k in range(10_000, 12_000)}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def test_components_of_linked_hubs_and_few_jobs(spark):
    # Two hubs that share members and hang together by a chain of large numbers, and two pairs.
    hubs = [(h, 10_000 + 3 * k) for h in (5_000_000, 7) for k in range(1500)]
    rows = hubs + [(6_000_000, 5_000_000), (6_000_000, 6_000_001), (1, 2), (3, 4), (4, 3), (9, 9), (8, None)]
    got = dict(map(tuple, components(spark.createDataFrame(rows, "u bigint, v bigint"), "test-hubs").collect()))
    assert got == {1: 1, 2: 1, 3: 3, 4: 3} | dict.fromkeys({x for row in rows[:3002] for x in row}, 7)
    context, name = spark.sparkContext, "test-component-jobs"
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "u bigint, v bigint").localCheckpoint()
    context.setJobGroup(name, name)
    try:
        assert sorted(map(tuple, components(links, "test-few").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
        jobs = len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 30
