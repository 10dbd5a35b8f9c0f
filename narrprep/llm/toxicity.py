"""Toxicity scores by weak supervision.

Voters are lexicon entries (words and word beginnings) and a few fixed patterns; each says toxic, clean or nothing.
A generative model of the votes estimates how reliable every voter is and which voters depend on each other, without
reading labels.  Its posterior labels train a linear classifier, which scores all documents.  The lexicon is picked
from labelled training rows: entries that are nearly only found in toxic rows, one after the other, each for the toxic
rows that those before it cover least.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import arrow_lists, held_out, runs, text_buffer, texts
from .hashing import LOWER, PIECE, mix, prefix, signed, span, tokens
from .labelled import SAMPLE, training_sample

#: Lengths, in bytes, of the word beginnings that may be entries.
BEGINNINGS = (4, 5, 6, 7)
#: An entry is found in this part of toxic rows at least, of all rows that hold it, and in so many toxic rows.
PURITY, LEAST = 0.95, 3
#: Entries that are handed to the driver, and those that become voters, at most.
ENTRIES, VOTERS = 20_000, 256
#: Picked entries that a toxic row should hold.
COVER = 4

LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = LETTERS.astype(bool) & (np.arange(256) < 91)
_MARKED = np.zeros(256, bool)
_MARKED[[ord(c) for c in "!*#@$%&"]] = True
PATTERNS = 3


def _entries(data: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """Every distinct word and word beginning with its text."""
    doc, _, h, start, end = tokens(data, offsets, i, j, LETTERS)
    hashes, docs = [h], [doc]
    a = int(offsets[i])
    for lo in range(a, int(offsets[j]), PIECE):
        # Words begin in this piece; the few bytes behind it complete their beginnings.
        piece = LOWER[data[lo : min(lo + PIECE + max(BEGINNINGS), int(offsets[j]))]]
        sums = prefix(piece)
        for n in BEGINNINGS:
            mine = np.flatnonzero((start >= lo) & (start < lo + PIECE) & (end - start >= n))
            at = start[mine] - lo
            hashes.append(mix(span(sums, at, at + n) ^ np.uint64(n)))
            docs.append(doc[mine])
    t, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((t, d))
    t, d = t[order], d[order]
    new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1])) if len(t) else np.zeros(0, bool)
    return t[new], d[new]


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fixed pattern votes of every text: shouting, runs of marks, marks inside words."""
    n = len(offsets) - 1
    out = np.zeros((n, PATTERNS), bool)
    for i, j in runs(offsets, PIECE):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(part):
            continue
        letter, mark = LETTERS[part] > 0, _MARKED[part]
        inside = np.zeros(len(part), bool)
        inside[1:-1] = mark[1:-1] & letter[:-2] & letter[2:]
        pairs = np.zeros(len(part), bool)
        pairs[1:] = mark[1:] & mark[:-1]
        sums = [np.append(0, np.cumsum(x)) for x in (letter, _UPPER[part], pairs, inside)]
        letters, upper, marks, within = (s[at[1:]] - s[at[:-1]] for s in sums)
        out[i:j] = np.column_stack([upper * 2 > letters, marks * 50 > letters, within > 0])
    return out


def _sample_entries(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        label = np.asarray(batch.column("label"))
        for i, j in runs(offsets, PIECE):
            t, d = _entries(data, offsets, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(signed(t)), pa.array(label[i:j][d].astype(np.int32))], names=["entry", "toxic"])


def _features(data: np.ndarray, offsets: np.ndarray, entries: np.ndarray):
    """Text and number of every entry (of a sorted table) found, patterns behind the entries."""
    texts_of, found = [], []
    for i, j in runs(offsets, PIECE):
        t, d = _entries(data, offsets, i, j)
        if len(t) and len(entries):
            at = np.minimum(np.searchsorted(entries, t), len(entries) - 1)
            hit = entries[at] == t
            texts_of.append(d[hit] + i)
            found.append(at[hit])
    row, number = np.nonzero(_patterns(data, offsets))
    texts_of.append(row)
    found.append(number + len(entries))
    return np.concatenate(texts_of), np.concatenate(found)


def _sample_features(batches, entries: np.ndarray):
    for batch in batches:
        d, f = _features(*text_buffer(batch.column("text")), entries)
        order = np.lexsort((f, d))
        count = np.bincount(d, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), arrow_lists(f[order].astype(np.int32), count, pa.int32())],
            names=["doc_id", "label", "found"],
        )


def pick_lexicon(rows: list[tuple[int, list[int]]], n_entries: int) -> list[int]:
    """Entries picked greedily: each is found in the most toxic rows that hold fewer than ``COVER`` picked ones.

    Rows are labels and the entries found.  Words that only copies of one row share are not needed once those rows
    are covered.
    """
    at: dict[int, set[int]] = {}
    for k, (label, found) in enumerate(rows):
        if label:
            for f in found:
                if f < n_entries:
                    at.setdefault(f, set()).add(k)
    need = dict.fromkeys(set().union(*at.values()), COVER) if at else {}
    picked = []
    while at and len(picked) < VOTERS:
        best = min(at, key=lambda f: (-len(at[f]), f))
        covered = at.pop(best)
        if len(covered) < LEAST:
            break
        picked.append(best)
        for k in covered:
            need[k] -= 1
        done = {k for k in covered if not need[k]}
        at = {f: left for f, held in at.items() if (left := held - done)} if done else at
    return picked


@dataclass
class LabelModel:
    """Votes 0 (nothing), 1 (toxic), 2 (clean): log odds of every vote, and how far voters say the same.

    Saying nothing counts for nothing.  Voters that speak in one row share their weight as far as they depend on
    each other: each counts by one over the sum of its correlations with those that speak.
    """

    prior: float
    odds: np.ndarray
    linked: np.ndarray
    accuracy: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        share = np.maximum((votes > 0).astype(float) @ self.linked, 1.0)
        margin = np.log(self.prior / (1 - self.prior)) + (self.odds[np.arange(votes.shape[1]), votes] / share).sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_label_model(votes: np.ndarray, guess: np.ndarray, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over the votes alone, from a first guess per row.

    Correlations are those that the posterior leaves unexplained.
    """
    n, voters = votes.shape
    says = [(votes == v).astype(float) for v in range(3)]
    p = guess
    linked = np.eye(voters)
    for step in range(rounds):
        prior = float(np.clip(p.mean(), 1e-3, 1 - 1e-3))
        toxic = np.stack([(p @ x + 0.5) / (p.sum() + 1.5) for x in says], 1)
        clean = np.stack([((1 - p) @ x + 0.5) / ((1 - p).sum() + 1.5) for x in says], 1)
        odds = np.log(toxic / clean)
        odds[:, 0] = 0.0
        if step >= 2:
            expected = np.outer(p, toxic[:, 1] - toxic[:, 2]) + np.outer(1 - p, clean[:, 1] - clean[:, 2])
            left = says[1] - says[2] - expected
            size = np.sqrt((left**2).mean(0)) + 1e-9
            linked = (left.T @ left) / n / np.outer(size, size)
            linked[linked < 3 / np.sqrt(n) + 0.1] = 0
            np.fill_diagonal(linked, 1.0)
        p = LabelModel(prior, odds, linked, np.zeros(0)).posterior(votes)
    right = says[1].T @ p + says[2].T @ (1 - p)
    return LabelModel(prior, odds, linked, right / np.maximum((says[1] + says[2]).sum(0), 1e-9))


def fit_linear(rows: np.ndarray, features: np.ndarray, n_rows: int, n_features: int, p: np.ndarray, decay: float = 1e-6):
    """Logistic regression on soft labels; a row is the set of its features."""
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, 1501):
        out = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[features], n_rows) + b, -40, 40)))
        gap = (out - p) / max(n_rows, 1)
        g = np.append(np.bincount(features, gap[rows], n_features) + decay * w, gap.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g**2 - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


@dataclass
class ToxicityModel:
    entries: np.ndarray
    weights: np.ndarray
    bias: float
    labels: LabelModel | None = None

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        d, f = _features(data, offsets, self.entries)
        margin = np.bincount(d, self.weights[f], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> ToxicityModel:
    """Model out of at most ``most`` labelled documents outside the held-out fifth.

    The driver holds the entries found of each sampled document, out of ``ENTRIES`` candidates.  Without toxic rows
    the score of every document is low and equal but for its patterns.
    """
    sample = stage(training_sample(docs, labels, label, most), "toxicity-sample")
    counted = sample.mapInArrow(_sample_entries, "entry bigint, toxic int").groupBy("entry").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")
    )
    pure = counted.filter((F.col("toxic") >= LEAST) & (F.col("toxic") >= PURITY * F.col("n")))
    candidates = [r["entry"] for r in pure.orderBy(F.desc("toxic"), "entry").limit(ENTRIES).collect()]
    entries = np.sort(np.array(candidates, np.int64).view(np.uint64))
    found = sample.mapInArrow(partial(_sample_features, entries=entries), "doc_id bigint, label int, found array<int>")
    rows = sorted((r["doc_id"], r["label"], r["found"]) for r in found.collect())
    picked = pick_lexicon([r[1:] for r in rows], len(entries))
    order = np.argsort(entries[picked]) if picked else []
    lexicon = entries[np.array(picked, int)][order] if picked else np.zeros(0, np.uint64)
    number = {int(np.searchsorted(entries, e)): k for k, e in enumerate(lexicon)}
    number |= {len(entries) + k: len(lexicon) + k for k in range(PATTERNS)}
    votes = np.zeros((len(rows), len(lexicon) + PATTERNS + 1), np.int64)
    for k, (_, _, held) in enumerate(rows):
        mine = [number[f] for f in held if f in number]
        votes[k, mine] = 1
        # One voter speaks for clean: no word of the lexicon is found.
        votes[k, -1] = 0 if any(f < len(lexicon) for f in mine) else 2
    if not len(rows):
        return ToxicityModel(lexicon, np.zeros(len(lexicon) + PATTERNS), -4.0)
    # The patterns say little by themselves, so the lexicon makes the first guess.
    guess = np.where((votes[:, : len(lexicon)] == 1).any(1), 0.95, 0.02)
    model = fit_label_model(votes, guess)
    row, feature = np.nonzero(votes[:, :-1])
    weights, bias = fit_linear(row, feature, len(rows), len(lexicon) + PATTERNS, model.posterior(votes))
    return ToxicityModel(lexicon, weights, bias, model)


def _scored(batches, model: ToxicityModel):
    for batch in batches:
        score = model.score(*text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score at least ``threshold``) of every document.

    Whole texts are read, nothing else; a null text is an empty one and scores like a text without any entry.
    Repeated rows get equal scores; a null id is never held out; an empty table gives an empty one; other columns are
    ignored.
    """
    model = fit_toxicity(docs, labels, **options)
    scored = texts(docs).mapInArrow(partial(_scored, model=model), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
