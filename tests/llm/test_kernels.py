"""Parts that run inside tasks, against plain statements of the same thing."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from narrprep.llm import best_fit_packing as packing
from narrprep.llm import quality
from narrprep.llm.best_fit_packing import WordTokens, best_fit
from narrprep.llm.common import runs, text_buffer
from narrprep.llm.hashing import PIECE, WORDS, shingles, tokens
from narrprep.llm.jaccard_join import divide_skip
from narrprep.llm.nearest import walk
from narrprep.llm.quality import fit_network
from narrprep.llm.queries import tokenizer_path
from narrprep.llm.secret_scan import RULES, trigram_query
from narrprep.llm.suffix_dedup import window_runs
from narrprep.llm.toxicity import fit_label_model, pick_lexicon


def groups_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_words_and_shingles_of_many_texts():
    texts = ["A b\tc", "", "a  b c d e f", None, "x" * (PIECE + 10) + " y " + "z " * PIECE, "é\x0bA"]
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    seen = {}
    for i, j in runs(offsets, 64):
        doc, _, h, s, e = tokens(data, offsets, i, j, WORDS)
        for d, x, a, b in zip(doc.tolist(), h.tolist(), s.tolist(), e.tolist()):
            seen.setdefault(i + d, []).append((x, data[a:b].tobytes().decode()))
    assert [[w for _, w in seen.get(k, [])] for k in range(len(texts))] == [(t or "").split() for t in texts]
    assert seen[0][0][0] == seen[2][0][0] and seen[0][1][0] == seen[2][1][0]
    t, d = shingles(np.array([x for x, _ in seen[2]] + [x for x, _ in seen[0]], np.uint64), np.repeat([0, 2], [6, 3]), 3)
    assert sorted(d.tolist()) == [0, 0, 2] and len(set(t.tolist())) == 3


@pytest.mark.parametrize("digit", [3, 5, 8])
def test_window_runs_cover_every_window_once(digit):
    rng = random.Random(digit)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    data, offsets = text_buffer(pa.array(texts))
    _, run, doc, lo, n = window_runs(data, offsets, 8, digit)
    windows = sorted((d, a + k) for d, a, m in zip(doc.tolist(), lo.tolist(), n.tolist()) for k in range(m))
    assert windows == [(d, a) for d, t in enumerate(texts) for a in range(len(t) - 7)]
    whole = {}
    for r, d, a, m in zip(run.tolist(), doc.tolist(), lo.tolist(), n.tolist()):
        assert whole.setdefault(r, texts[d][a : a + m + 7]) == texts[d][a : a + m + 7]


def test_divide_skip_finds_the_groups():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = [set(rng.integers(0, 400, rng.integers(1, 60)).tolist()) for _ in range(5)]
        sets = []
        for _ in range(60):
            one = {x for x in base[rng.integers(5)] if rng.random() > 0.08} | set(rng.integers(0, 400, rng.integers(0, 4)).tolist())
            sets.append(frozenset(one))
        sets = sorted({s for s in sets if s}, key=len)
        links = divide_skip(np.array([x for s in sets for x in sorted(s)]), np.array([len(s) for s in sets]), 80).tolist()
        truth = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert groups_of(len(sets), links) == groups_of(len(sets), truth)


def test_best_fit_fills_gapless_and_bounded():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    for open_bins in (1, 5, 1000):
        bins, offsets = best_fit(lengths, 100, open_bins)
        fill = {}
        for b, o, n in zip(bins, offsets, lengths):
            assert fill.get(b, 0) == o
            fill[b] = o + n
        assert max(fill.values()) <= 100
    ordered = sorted(lengths, reverse=True)
    assert max(best_fit(ordered, 100, 1000)[0]) + 1 <= -(-sum(lengths) // 100) * 1.05


def test_word_tokens_are_those_of_the_text():
    found = WordTokens(tokenizer_path())
    texts = ["a<|endoftext|>b <|ENDOFTEXT|> it's don'T", "\x01 \x01x \x1c a\x1db  x y", "é É̇ ΟΔΟΣ İs ß 123 4五", "", " \n\t\r ", "x" * 300]
    for text, got in zip(texts, found.texts(texts)):
        assert np.frombuffer(got, "<u4").tolist() == found.tokenizer.encode(text, add_special_tokens=False).ids
    assert zlib.crc32(b"\x01\0\0\0") == 2583214201


def test_word_tokens_with_marks_and_a_full_memory(monkeypatch):
    monkeypatch.setattr("narrprep.llm.best_fit_packing.REMEMBERED", 300)
    rng = random.Random(1)
    letters = "ab é'ñ.,;:!?#&-_'s't're'll09²½一\u0301ἀΣς<|endoftext|>\x01 \t\nİ\u0958"
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(600)]
    texts += ["don't. it's, we're; abc's! <|endoftext|>. x<|endoftext|>abc. ΑΣ. İ? \u0958!", "x" * 100 + "."]
    tokens_of = WordTokens(tokenizer_path())
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        for text, found in zip(part, tokens_of.texts(part), strict=True):
            assert found == np.array(tokens_of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_runs_of_letters_are_encoded_together_and_marks_once():
    tokens_of = WordTokens(tokenizer_path())
    chars = [chr(c) for c in range(1, 0x250)]
    asked, ids_of = [], tokens_of._ids
    tokens_of._ids = lambda text: asked.append(text) or ids_of(text)
    many = ["Été ÉTÉ$$$ größe%%% Größe***. x-- (a) été", "été$$$ größe%%% a\u0301$ \u0410$", " ".join(f"{c} x{c}y {c}{c} x{c}= {c}$" for c in chars)]
    many += [" ".join(f"{c}s {c}ll{c}t" for c in chars[: 1 + n]) for n in (90, 200, 500)]
    for text, found in zip(many, tokens_of.texts(many[:2])):
        assert found == np.array(tokens_of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    together = [text for text in asked if packing.BETWEEN not in text]
    assert sorted(together[0].split()) == ["größe", "x", "été"]
    for text, found in zip(many, tokens_of.texts(many), strict=True):
        assert found == np.array(tokens_of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_letters_that_a_tokenizer_parts_are_encoded_one_by_one():
    tokens_of = WordTokens(tokenizer_path())
    tokens_of.last[:] = False
    texts = ["some plain words", "été some more"]
    for text, found in zip(texts, tokens_of.texts(texts), strict=True):
        assert found == np.array(tokens_of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_cells_are_walked_from_the_best():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=6), rng.normal(size=5)
    held = rng.integers(0, 3, (6, 5))
    cells = walk(a, b, held, 10**9)
    score = [a[i] + b[j] for i, j in cells]
    assert score == sorted(score, reverse=True) and len(cells) == (held > 0).sum()
    assert sum(held[c] for c in walk(a, b, held, 7)) >= 7


def test_trigrams_of_every_match_are_asked_for():
    asked = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert asked["hex"] == [] and asked["access"] == [{"aki", "kia"}]
    for text in ("password = abcdefgh1", "Api_Key:12345678", "APIKEY='abcdefghi", "token=abcdefgh"):
        low = text.lower()
        assert any(all(t in low for t in terms) for terms in asked["assign"])
    assert trigram_query("ab|xyz+") == [] and trigram_query("(abc)?def") == [{"def"}]


def test_lexicon_and_label_model():
    rows = [(1, [0, 1]), (1, [0, 2]), (1, [0]), (0, []), (1, [3]), (1, [3]), (1, [3])]
    assert pick_lexicon(rows, 4) == [0, 3]
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    votes = np.zeros((2000, 4), int)
    for k, hit in enumerate((0.9, 0.7, 0.5)):
        votes[:, k] = (truth & (rng.random(2000) < hit)) | (~truth & (rng.random(2000) < 0.01))
    votes[:, 3] = np.where(votes[:, :3].any(1), 0, 2)
    p = fit_label_model(votes, np.where(votes[:, 0] == 1, 0.9, 0.1)).posterior(votes)
    assert ((p > 0.5) == truth).mean() > 0.95


def test_network_without_usable_labels():
    empty = fit_network(np.zeros((0, 3)), np.zeros(0, int))
    assert empty.score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    alone = fit_network(np.zeros((9, 3)), np.ones(9, int))
    assert (alone.score(np.ones((2, 3))) > 0.99).all()


def test_a_worker_gives_back_what_the_packing_kept():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "label": pa.array([1], pa.int32()), "text": ["a few words, a few more"]})
    vectors = np.zeros((quality.BUCKETS, quality.SIZE), np.float32)
    model = vectors, fit_network(np.zeros((0, quality.SIZE)), np.zeros(0, int))
    for task in (
        lambda: quality._add_contexts([batch]), lambda: quality._pooled([batch], vectors), lambda: quality._scored([batch], model, "text", "score")
    ):
        list(packing._pieces([batch], tokenizer_path(), 4096, 1, False))
        assert packing._loaded
        assert [out.num_rows for out in task()] == [1]
        assert not packing._loaded


def test_word_contexts_take_little_room():
    """Three tables of the result's size stand at once, of which one is the result."""
    batch = pa.RecordBatch.from_pydict({"text": ["one two three one two"]})
    tracemalloc.start()
    (out,) = quality._add_contexts([batch])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    table = np.frombuffer(out.column("table")[0].as_py(), np.float32).reshape(quality.BUCKETS, quality.SIZE)
    index = quality.index_vectors()
    word = [quality.stream(*quality.text_buffer(pa.array([w])), 0, 1)[0][0] for w in ("one", "two", "three")]
    assert (table[word[2]] == 2 * index[word[0]] + 2 * index[word[1]]).all()
    assert most < 50e6
