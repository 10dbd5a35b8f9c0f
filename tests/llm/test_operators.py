"""Operators against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from narrprep.llm import queries as Q
from narrprep.llm.best_fit_packing import best_fit_packing
from narrprep.llm.components import components
from narrprep.llm.decontamination import benchmark_hits, decontaminate
from narrprep.llm.jaccard_join import _neighbourhoods, jaccard_join, one_of_each_group
from narrprep.llm.line_dedup import line_dedup
from narrprep.llm.nearest import nearest
from narrprep.llm.quality import keep_good, quality_scores
from narrprep.llm.quotations import conversations, replies
from narrprep.llm.secret_scan import digest, listed, secret_scan
from narrprep.llm.suffix_dedup import suffix_dedup
from narrprep.llm.toxicity import toxicity_scores

#: Names that the operators use themselves.
CLASH = "row_doc bigint, row_text string, n bigint, c string, t string, digit bigint, runs string, ids string, score string, hits string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"


def table(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names clash."""
    return spark.createDataFrame([(d, t, None, s, len(t or ""), 1, "a", 2, "b", "c", 3, "d", "e", "f", "g") for d, t, s in rows], SCHEMA)


def words(rng, n, kinds=60):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng, rng.randrange(30, 80)) for _ in range(8)]
    rows = [(k, t, f"s{k % 4}") for k, t in enumerate(base)]
    for k in range(8, 40):
        parts = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            parts[rng.randrange(len(parts))] = f"x{rng.randrange(1000)}"
        rows.append((k, "\n".join(" ".join(parts[i : i + 20]) for i in range(0, len(parts), 20)), f"s{k % 4}"))
    rows += [(40, None, None), (41, "", "s1"), (42, "one two", "s1"), (43, "ONE  two", "s2"), (44, " \n\t", None), (None, base[0], None)]
    rows += [rows[0], rows[0], (45, " ".join([base[1]] * 60), "s3"), (0, base[2], "s0"), (46, "é" * 50 + base[3], "s2")]
    return rows


def by_rows(rows):
    return collections.Counter(map(repr, rows))


def test_suffix_dedup(spark, corpus):
    length = 40
    texts = [(t or "").encode() for _, t, _ in corpus]
    count = collections.Counter(t[a : a + length] for t in texts for a in range(len(t) - length + 1))
    want = []
    for (doc, _, _), t in zip(corpus, texts):
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = b"\x01" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        want.append((doc, len(t), spans, bytes(x for x, g in zip(t, gone) if not g)))
    got = suffix_dedup(table(spark, corpus), length, (20, 32)).collect()
    assert by_rows((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got) == by_rows(want)


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n  Footer  \n\nother {k % 2}", f"s{k % 3}") for k in range(9)]
    rows += [(9, "Footer", None), (10, None, "s0"), (11, "", "s1"), (None, "Footer\nFooter\nx", "s1"), rows[0]]
    got = line_dedup(table(spark, rows), min_sites=3, min_texts=4).select("doc_id", "text", "n_lines", "n_removed", "n_chars", "c").collect()

    def kept(doc, text):
        if text is None:
            return doc, None, 0, 0, 0, "b"
        lines = text.split("\n")
        common = {"Footer", "other 0", "other 1"}
        left = [x for x in lines if x.strip(" ") not in common]
        return doc, "\n".join(left), len(lines), len(lines) - len(left), len("\n".join(left)), "b"

    # "other 0" and "other 1" stand in four texts each, but "other 1" and "other 0" on three sites.
    assert by_rows(map(tuple, got)) == by_rows(kept(d, t) for d, t, _ in rows)


def sets_of(rows, size=5):
    out = []
    for _, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def test_jaccard_join(spark, corpus):
    sets = sets_of(corpus)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _, _) in enumerate(corpus):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = [(doc, len(sets[i]), least.get(find(i), doc) if sets[i] else doc) for i, (doc, _, _) in enumerate(corpus)]
    # A small block cuts neighbourhoods into parts.
    for block in (1_500_000, 400):
        got = jaccard_join(table(spark, corpus), block=block).select("doc_id", "n_shingles", "component_id").collect()
        assert by_rows(map(tuple, got)) == by_rows(want)
    kept = one_of_each_group(table(spark, corpus))
    assert kept.columns == table(spark, []).columns
    # One document per brute-force group, also where two groups share their least id; equal rows without words are one.
    heads = {find(i): w[2] for i, (w, s) in enumerate(zip(want, sets)) if s}
    empty = {(d, t) for (d, t, _), s in zip(corpus, sets) if not s}
    assert by_rows(r["doc_id"] for r in kept.collect()) == by_rows([*heads.values(), *(d for d, _ in empty)])


def test_neighbourhoods_do_not_follow_chains(spark):
    # Class k is entered with k + 1 under shingle k; 300 meets 301 under 1000, one band higher, and so on.
    entries = [(k + d, 7, k) for k in range(200) for d in (0, 1)]
    entries += [(300 + k + d, 7 + d, 1000 + k) for k in range(50) for d in (0, 1)]
    entries += [(c, 3, t) for c in range(500, 520) for t in range(2000, 2030) if (c + t) % 11] + [(600, 7, 5000), (601, 9, 5000)]
    got = _neighbourhoods(spark.createDataFrame(entries, "c bigint, band int, t bigint")).collect()
    held = {}
    for r in got:
        held.setdefault(r["root"], []).append(r["node"])
    assert all(len(nodes) == len(set(nodes)) for nodes in held.values())
    lists = {}
    for c, band, t in entries:
        lists.setdefault((t, band), set()).add(c)
    pairs = {(a, b) for (t, band), low in lists.items() for up in (low, lists.get((t, band + 1), ())) for a in low for b in up if a != b}
    assert all(any(a in nodes and b in nodes for nodes in held.values()) for a, b in pairs)
    assert not {600, 601} & {r["node"] for r in got}
    assert max(len(nodes) for root, nodes in held.items() if root < 500) <= 3
    # Lists of one group of copies have several heads; one neighbourhood holds them all.
    assert [len(nodes) for root, nodes in held.items() if root >= 500] == [20]


def test_one_of_each_group_with_shared_and_null_ids(spark):
    rng = random.Random(11)
    base = [words(rng, 60) for _ in range(4)]
    near = [f"{t} y{k}" for k, t in enumerate(base)]
    rows = [(7, base[0], "a"), (7, base[1], "b"), (8, near[1], "c"), (9, near[0], "d")]
    rows += [(None, base[2], "e"), (None, near[2], "f"), (None, base[3], "g"), (5, near[3], "h"), (None, None, "i")]
    sets = sets_of(rows)
    alike = [{j for j, b in enumerate(sets) if a and 100 * len(a & b) >= 80 * len(a | b)} for a in sets]
    assert sorted({tuple(sorted(g)) for g in alike if g}) == [(0, 3), (1, 2), (4, 5), (6, 7)]
    kept = [(r["doc_id"], r["text"]) for r in one_of_each_group(table(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted(
        [(7, base[0]), (7, base[1]), (5, near[3]), (None, None), *[k for k in kept if k in {(None, base[2]), (None, near[2])}]], key=repr
    )
    # One document per group, whichever of the two without an id.
    assert len(kept) == 5


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)] + [(5, 5), (None, 3)]
    found = components(spark.createDataFrame(links, "u bigint, v bigint"), "test").collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert {(r["node"], r["root"]) for r in found} == {(x, find(x)) for x in list(root)}


def test_secret_scan(spark):
    key = "AKIA" + "A1" * 8
    texts = [
        f"é password: 'abcdefgh' token=short; {key} x", "password: secret: abcdefghijk", "a" * 31 + " " + "0af" * 12, f"{key}{key}\n{key}",
        "API_KEY=token=abcdefghij " + "f" * 40, None, "", "Passwd = \"x.y/z+1=2\" AKIAshort", "secret=" + "ab" * 20, "ghp_" + "a" * 30,
    ]
    texts.append(texts[0])
    patterns = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32),
    ]
    want = []
    for k, text in enumerate(texts):
        spans = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, g, least) in enumerate(patterns)
                 for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= least]
        count = [sum(s[1] == n for s in spans) for n in range(3)]
        want.append((k, *count, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest()))
    df = table(spark, [(k, t, None) for k, t in enumerate(texts)])
    found = secret_scan(df)
    got = digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    assert by_rows(map(tuple, got)) == by_rows(want)
    assert "prefixed:0:34" in found.filter("doc_id = 9").select(listed(F.col("spans"))).first()[0]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype("float32").astype(float)
    x[250:] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, None] * 4), (1080, [float("inf")] * 8), (1100, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    got = collections.defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=5, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        order = [v for v in np.lexsort((np.arange(300), -score)).tolist() if v != q][:5]
        assert [(k, v) for k, v, _ in found] == list(enumerate(order, 1))
        assert [s for *_, s in found] == [score[v] for v in order]


def test_quotations(spark):
    rows = [
        (1, 0, "user", "First line\nsecond  line"), (1, 1, "assistant", "Other"), (1, 2, "user", "> second line\nanswer"),
        (1, 3, "assistant", ">> first LINE\n> answer\n\nmore"), (1, 4, None, "> nobody said this\nalone"), (1, 5, "user", "> first line second line\n"),
        (2, 0, "user", None), (2, 0, "user", None), (None, 1, "user", "x"), (2, None, "user", "y"), (3, 9, "user", "> answer"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("original", F.lit("x"))
    told = {(r["conv_id"], r["turn"]): r for r in replies(df).collect()}
    assert [told[1, k]["original"] for k in range(6)] == [None, None, 0, 2, None, 0]
    assert [told[1, k]["thread"] for k in range(6)] == [0, 1, 0, 0, 4, 0]
    chats = collections.Counter((r["conv_id"], r["n_messages"], r["n_replies"], r["chat"]) for r in conversations(df).collect())
    first = "user: First line\nsecond  line\nuser: answer\nassistant: more\nuser: \nassistant: Other\nunknown: alone"
    assert chats == collections.Counter([(1, 6, 3, first), (2, 1, 0, "user: "), (None, 1, 0, "user: x"), (2, 1, 0, "user: y"), (3, 1, 0, "user: ")])


def test_decontamination(spark):
    rng = random.Random(8)
    items = [words(rng, n, 5000) for n in (12, 30, 60)] + ["two words", None, ""]
    items = spark.createDataFrame(list(enumerate(items)) + [(None, "lonely")], "item_id bigint, text string")
    held = [r["text"] for r in items.orderBy("item_id").filter("item_id < 3").collect()]
    near = held[2].split()
    near[20] = "other"
    docs = [(k, f"{words(rng, 100, 5000)} {t.upper()}, {words(rng, 50, 5000)}", None) for k, t in enumerate(held)]
    docs += [(3, words(rng, 400, 5000), None), (4, None, None), (5, "", None), (6, held[1], None), (7, words(rng, 9, 5000) + "\n" + " ".join(near), None)]
    docs += [(8, " ".join(held[2].split()[:25]), None), docs[1], (9, "x two\nwords y", None)]
    df = table(spark, docs)
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 3)) for r in benchmark_hits(df, items).collect()}
    assert {k: v for k, v in got.items() if k[0] != 7} == {
        (0, 0): (100, 12, 1.0), (1, 1): (100, 30, 1.0), (2, 2): (100, 60, 1.0), (6, 1): (0, 30, 1.0), (9, 3): (1, 2, 1.0)
    }
    assert got[7, 2][:2] == (9, 60) and 0.8 <= got[7, 2][2] < 1
    left = decontaminate(df, items)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 8]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(Q.tokenizer_path()).encode
    rows = best_fit_packing(table(spark, corpus), Q.tokenizer_path(), length=64, open_bins=8, rows_per_task=20).collect()
    want = []
    for doc, text, _ in corpus:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(doc, k, s, len(ids[s : s + 64]), __import__("zlib").crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert by_rows((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == by_rows(want)
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64


@pytest.mark.parametrize("scores, label", [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_classifiers(spark, scores, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = Q.read(spark, sf, "documents"), Q.read(spark, sf, "labels")
    odd = spark.createDataFrame([(None, "a b"), (10**6, None), (10**6 + 1, "")], "doc_id bigint, text string")
    got = scores(docs.select("doc_id", "text").unionByName(odd), labels)
    judged = got.join(labels, "doc_id").filter("held_out")
    assert judged.selectExpr(f"avg(cast(predicted = {label} as double))").first()[0] >= 0.94
    assert got.filter("score is null or score < 0 or score > 1").isEmpty() and got.count() == docs.count() + 3
    assert got.filter("held_out").count() == got.filter("crc32(cast(doc_id as string)) % 5 = 0").count()


def test_empty_tables(spark):
    none = table(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    chat = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    for found in (
        suffix_dedup(none), line_dedup(none), jaccard_join(none), secret_scan(none), quality_scores(none, labels),
        nearest(vectors, F.lit(True)), conversations(chat), toxicity_scores(none, labels), benchmark_hits(none, items),
        best_fit_packing(none, Q.tokenizer_path()),
    ):
        assert found.count() == 0


def test_pipeline_stages_keep_columns(spark, small):
    docs = Q.read(spark, small, "documents")
    labels, items = Q.read(spark, small, "labels"), Q.read(spark, small, "benchmark")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"
    ]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    good = corpus_pipeline.quality(spark, docs, small)
    assert good.columns == docs.columns and ids(good) == ids(quality_scores(docs, labels).filter("predicted = 1"))
    assert ids(good) == ids(keep_good(docs, labels))
    lines = corpus_pipeline.lines(spark, docs, small)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    clean = corpus_pipeline.benchmark(spark, docs, small)
    assert clean.columns == docs.columns and ids(clean) == ids(docs) - ids(benchmark_hits(docs, items))
    assert corpus_pipeline.run(spark, small).count() > 0
