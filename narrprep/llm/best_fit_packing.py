"""Packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import KEPT, texts

#: Words whose tokens a worker remembers in each of two generations, and the longest word it does.
REMEMBERED, LONGEST = 500_000, 48
#: Marks at the end of a word that the tokenizer parts from letters and digits before them.
MARKS = ".,;:!?#&$%*\"()[]{}-_/\\@^`~+="
#: Letters that stay as they are in lower case and composed; the tokenizer never parts a run of them.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: What the tokenizer puts behind the last token of such a run.
LAST = "</w>"
#: A character that is a token of its own, put between words that are encoded together.
BETWEEN = "\x01"


def _ends_whole(char: str) -> bool:
    """A letter or digit that still ends in one as the tokenizer writes it, in lower case and composed."""
    return char.isalnum() and (char.isascii() or unicodedata.normalize("NFC", char).lower()[-1].isalnum())


def _low(text: str) -> str:
    """Text without case; names of special tokens and what other letters become are left to the tokenizer."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class WordTokens:
    """Token ids of words, as little-endian bytes.

    The tokenizer splits at white space and drops it, so the tokens of a text are those of its words; a word is
    encoded once.  Only characters that the tokenizer itself treats as white space divide words here.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self._ids(BETWEEN)
        if len(self.between) != 1:
            raise ValueError("the tokenizer has no single token for the character between words")
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(words.values(), default=0) + 1, bool)
        self.last[[n for word, n in words.items() if word.endswith(LAST)]] = True

    def _ids(self, text: str) -> np.ndarray:
        # Positions in the text, which take longer than the tokens, are not asked for.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: set[str]) -> None:
        """Tokens of new words; of a word that ends in marks they are those of the word without them and of the marks."""
        parts = {}
        for word in words:
            stem = word.rstrip(MARKS)
            if len(stem) < len(word) <= LONGEST and stem and _ends_whole(stem[-1]):
                parts[word] = stem, word[len(stem) :]
        bare = words.difference(parts).union(*parts.values()).difference(self.known)
        self._encode(list(bare))
        for word, (stem, marks) in parts.items():
            self.known[word] = self.known[stem] + self.known[marks]

    def _encode(self, words: list[str]) -> None:
        runs, rest = [], []
        for word in words:
            (runs if LETTERS.fullmatch(word) else rest).append(word)
        for a in range(0, len(runs), 2000):
            some = runs[a : a + 2000]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._keep(some, ids, np.append(0, ends[:-1]), ends)
            else:
                rest += some
        plain = [w for w in rest if BETWEEN not in w]
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = self._ids(f" {BETWEEN} ".join(some))
            ends = np.append(np.flatnonzero(ids == self.between[0]), len(ids))
            self._keep(some, ids, np.append(0, ends[:-1] + 1), ends)
        for word in set(rest).difference(plain):
            self.known[word] = self._ids(word).tobytes()

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        found = ids.tobytes()
        for word, i, j in zip(words, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
            self.known[word] = found[i:j]

    def texts(self, batch: list[str]) -> Iterator[bytes]:
        split = [_low(text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in batch]
        found = [list(map(self.known.get, text)) for text in split]
        gaps = [[i for i, ids in enumerate(row) if ids is None] for row in found]
        new = {text[i] for text, at in zip(split, gaps, strict=True) for i in at}
        if len(self.known) + len(new) > REMEMBERED:
            # What was not met since the last turn is forgotten.
            self.older, self.known = self.known, {}
        again = {w: self.older[w] for w in new if w in self.older}
        self.known.update(again)
        new.difference_update(again)
        self._learn(new)
        for text, row, at in zip(split, found, gaps, strict=True):
            for i in at:
                row[i] = self.known[text[i]]
            yield b"".join(row)
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]


_loaded: dict[str, WordTokens] = {}
KEPT.append(_loaded)


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of a worker, which its later tasks find with the words it knows."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def _pieces(batches, path: str, length: int, end: int, with_ids: bool):
    tokens = word_tokens(path)
    last = end.to_bytes(4, "little")
    for batch in batches:
        ids, all_texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(ids):
            group = all_texts.slice(at, 64).to_pylist()
            rows = []
            for doc, found in zip(ids[at : at + 64], tokens.texts(group), strict=True):
                found += last
                for piece, start in enumerate(range(0, len(found), 4 * length)):
                    part = found[start : start + 4 * length]
                    rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            at += 64
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names)


def token_pieces(docs: DataFrame, path: str, length: int = 4096, end: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``length`` tokens: the tokens of every document, then ``end``, cut where they are longer.

    ``ids`` holds little-endian 32-bit ids, ``start`` the ids of the document before the piece.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return texts(docs).mapInArrow(partial(_pieces, path=path, length=length, end=end, with_ids=with_ids), schema)


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every item, in the order given.

    An item goes to the open bin it fills best.  Bit f of ``free`` says that some open bin has f places left, so that
    bin is the lowest bit at or above the item's length.  With more than ``open_bins`` open the fullest closes.
    """
    free, at, bins, offsets, made, n_open = 0, {}, [], [], 0, 0
    for n in lengths:
        fitting = free >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            held = at[left]
            number = held.pop()
            if not held:
                free &= ~(1 << left)
        else:
            left, number = size, made
            made += 1
            n_open += 1
        bins.append(number)
        offsets.append(size - left)
        left -= n
        if not left:
            n_open -= 1
            continue
        at.setdefault(left, []).append(number)
        free |= 1 << left
        if n_open > open_bins:
            fullest = (free & -free).bit_length() - 1
            at[fullest].pop()
            n_open -= 1
            if not at[fullest]:
                free &= ~(1 << fullest)
    return bins, offsets


def _pack(key, table: pa.Table, size: int, open_bins: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("row", "ascending")])
    bins, offsets = best_fit(table.column("length").to_pylist(), size, open_bins)
    first = key[0].as_py() << 40
    table = table.drop_columns(["row", "task"])
    return table.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column(
        "offset", pa.array(offsets, pa.int64())
    )


def best_fit_packing(
    docs: DataFrame, path: str, length: int = 4096, end: int = 1, open_bins: int = 4096, rows_per_task: int = 25_000
) -> DataFrame:
    """Place of every piece of every document in sequences of at most ``length`` tokens.

    Returns ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.  Sequences
    hold no gap.  A null or empty text is the ``end`` token alone; repeated rows and null ids are packed like
    others; an empty table gives an empty one; other columns are ignored.  ``path`` names the tokenizer's file, which
    every worker has.

    Only lengths are packed: pieces are dealt evenly into as many groups as hold ``rows_per_task`` rows, and a
    group is packed by itself, longest first, with ``open_bins`` open bins.  A group leaves few bins unfilled, so
    their share falls with the rows per group.
    """
    pieces = token_pieces(docs, path, length, end, with_ids=False).withColumn("row", F.monotonically_increasing_id())
    pieces = stage(pieces, "packing-pieces")
    groups = max(1, -(-pieces.count() // rows_per_task))
    schema = (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("task").applyInArrow(lambda key, table: _pack(key, table, length, open_bins), schema)
