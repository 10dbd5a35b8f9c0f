"""Chunking against a plain Python statement of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from narrprep.functions.arrays import TAIL, group_starts, last_start_at, running_offsets
from narrprep.functions.packing import force_split, split_long
from narrprep.operators.chunks import chunk_documents, sentence_rows

def squeezed(text):
    return "".join(text.split())


def check_chunks(text, chunks, limit, least):
    """What must hold of the chunks of a text, whatever way they were found."""
    paragraphs = [p for p in re.split(r"\n\n+", text) if p.strip()]
    assert squeezed("".join(c for c, _, _ in chunks)) == squeezed(text)
    assert [i for _, i, _ in chunks] == sorted(i for _, i, _ in chunks)
    for chunk, i, ends in chunks:
        assert len(chunk) <= limit or " " not in chunk
        assert not ends or i < len(paragraphs) - 1
    for (one, i, ends), (two, j, _) in zip(chunks, chunks[1:]):
        assert len(one) >= least or len(one) + 1 + len(two) > limit
        assert not (ends and i == j)
        sentences = re.split(r"(?<=[.!?])\s+|(?<=[.!?][\"')\]])\s+", paragraphs[i].strip())
        if i == j and max(map(len, sentences)) <= limit:
            following = next(x for x in sentences if two.startswith(x))
            assert len(one) + 1 + len(following) > limit


def random_text(rng):
    words = ["a", "bb", "word", "sentence", "and", "because", "long" * 12, "é", "x,", "y;", "end.", "stop!", "so?\"", "ok.)"]
    parts = []
    for _ in range(rng.randrange(1, 120)):
        parts.append(rng.choice(words))
        parts.append(rng.choice([" ", " ", " ", "  ", "\n", "\n\n"]))
    return "".join(parts)


@pytest.mark.parametrize("limit, least", [(40, 10), (100, 50), (400, 50)])
def test_chunks_are_full_and_whole(spark, limit, least):
    rng = random.Random(limit)
    texts = [random_text(rng) for _ in range(150)] + ["", "  ", "One.", "x" * 1000, ("w " * 900).strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunk_documents(df, ["doc_id"], max_chars=limit, min_chars=least).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["para_idx"], r["paragraph_break_after"]))
    for i, text in enumerate(texts):
        check_chunks(text, got.get(i, []), limit, least)


def test_chunks_hold_every_word_and_the_limit(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    chunks = chunk_documents(docs, ["doc_id"])
    too_long = chunks.filter(F.length("text") > 400).filter(F.col("text").contains(" "))
    assert too_long.count() == 0
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    whole = chunks.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), " ").alias("t")
    )
    lost = docs.join(whole, "doc_id").filter(squeeze(F.col("t")) != squeeze(F.col("text")))
    assert lost.count() == 0


def test_sentences_end_with_a_mark(spark):
    df = spark.createDataFrame([("First here. Second here! Third (yes.) Fourth",)], "text string")
    assert [r["sentence"] for r in sentence_rows(df, []).collect()] == ["First here.", "Second here!", "Third (yes.)", "Fourth"]


def test_first_part_with_and_without_compat(one):
    exact = lambda c: force_split(c, 7)
    compat = lambda c: force_split(c, 7, compat=True)
    assert one(exact, "abc def ghi jkl") == ["abc def", "ghi jkl"]
    assert one(compat, "abc def ghi jkl") == ["abc", "def ghi", "jkl"]


def test_long_sentence_is_cut_at_breaks(one):
    found = one(lambda c: split_long(c, 20), "one two three, four five and six seven eight")
    assert found == ["one two three,", "four five and", "six seven eight"]


def test_folds_longer_than_their_tail(spark):
    n = 3 * TAIL + 5
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("a"))
    got = df.select(running_offsets(F.col("a"), 1)).first()[0]
    want, at = [], 0
    for x in range(1, n + 1):
        want.append(at)
        at += x + 1
    assert got == want
    numbers = df.select(last_start_at(F.col("a"), F.expr("sequence(5, 2000, 100)"))).first()[0]
    assert numbers == [0 if x < 5 else (x - 5) // 100 + 1 for x in range(1, n + 1)]


def test_folds_carry_no_array(spark):
    """``aggregate`` copies its state at every step, arrays element by element."""
    n = 3000
    lengths = F.sequence(F.lit(1), F.lit(n))
    items = F.transform(lengths, lambda v: F.struct(v.alias("n")))
    folds = {
        "offsets": running_offsets(lengths, 2),
        "starts": group_starts(items, lambda cur, x: cur + 1 + x["n"] > 2000, 1),
        "last": last_start_at(lengths, F.array(F.lit(5), F.lit(2000))),
    }
    df = spark.range(1).select(*[fold.alias(name) for name, fold in folds.items()])
    assert "flatten" not in df._jdf.queryExecution().analyzed().toString()
    row = df.first()
    at, offsets = 0, []
    for v in range(1, n + 1):
        offsets.append(at)
        at += v + 2
    starts, cur = [], None
    for v in range(1, n + 1):
        if cur is None or cur + 1 + v > 2000:
            starts.append(v)
            cur = v
        else:
            cur += v + 1
    assert row.offsets == offsets and row.starts == starts
    assert row.last == [0 if v < 5 else 1 if v < 2000 else 2 for v in range(1, n + 1)]
    empty = F.array().cast("array<int>")
    assert spark.range(1).select(running_offsets(empty, 2).alias("o"), last_start_at(empty, empty).alias("l")).first() == ([], [])
