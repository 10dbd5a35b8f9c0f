"""Quality scores: word vectors by random indexing, pooled per document, and a small calibrated network."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, held_out, let_go, runs, text_buffer, texts
from .hashing import PIECE, mix, tokens
from .labelled import SAMPLE, training_sample

BUCKETS = 1 << 15
SIZE = 64
#: Entries of an index vector that are not zero.
ENTRIES = 4
REACH = 2
#: Tasks that add up word vectors, each with a table of its own.
TABLES = 8

#: Letters, digits and marks are tokens of their own; blanks and control characters divide them.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127] = 3
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
#: Signs that stand beside a word: all upper case, and the same word as before.
_SHOUT, _AGAIN = mix(np.array([1, 2], np.uint64))


def stream(data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, marks and signs in order of the text, and their text."""
    doc, kind, h, start, end = tokens(data, offsets, i, j, KINDS)
    if not len(doc):
        return doc, doc
    word = np.flatnonzero(kind == 1)
    upper = np.append(0, np.cumsum(_UPPER[data[offsets[i] : offsets[j]]]))
    base = offsets[i]
    size = end[word] - start[word]
    shout = (size > 1) & (upper[end[word] - base] - upper[start[word] - base] == size)
    again = np.append(False, (h[word][1:] == h[word][:-1]) & (doc[word][1:] == doc[word][:-1]))
    place = np.concatenate([np.arange(len(h)) * 4, word[shout] * 4 + 1, word[again] * 4 + 2])
    hashes = np.concatenate([h, np.full(shout.sum(), _SHOUT), np.full(again.sum(), _AGAIN)])
    docs = np.concatenate([doc, doc[word[shout]], doc[word[again]]])
    order = np.argsort(place, kind="stable")
    return (hashes[order] % np.uint64(BUCKETS)).astype(np.int64), docs[order]


def index_vectors() -> np.ndarray:
    """Fixed random vector of every bucket: a few entries of plus or minus one."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, SIZE), np.float32)
    rows = 1 << 10  # all rows at once take many times the room of the result
    at = np.concatenate([np.argsort(rng.random((rows, SIZE)), axis=1)[:, :ENTRIES] for _ in range(BUCKETS // rows)])
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), (BUCKETS, ENTRIES)), axis=1)
    return out


def _add_contexts(batches):
    let_go()
    index = index_vectors()
    where = np.nonzero(index)[1].reshape(BUCKETS, ENTRIES)
    sign = np.take_along_axis(index, where, axis=1).astype(float)
    del index
    total = np.zeros(BUCKETS * SIZE)
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for i, j in runs(offsets, PIECE):
            bucket, doc = stream(data, offsets, i, j)
            for step in range(1, REACH + 1):
                near = doc[step:] == doc[:-step]
                a, b = bucket[:-step][near], bucket[step:][near]
                for one, other in ((a, b), (b, a)):
                    for k in range(ENTRIES):
                        np.add.at(total, one * SIZE + where[other, k], sign[other, k])
    yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["table"])


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Vector of every bucket: its index vector and the sum of those around it, each of length one."""
    parts = sample.select("text").repartition(TABLES).mapInArrow(_add_contexts, "table binary").toLocalIterator()
    total = np.zeros((BUCKETS, SIZE), np.float32)
    for row in parts:
        total += np.frombuffer(row["table"], np.float32).reshape(BUCKETS, SIZE)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return (index_vectors() / np.sqrt(np.float32(ENTRIES)) + total / np.maximum(length, 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean vector of every text; zero where there is no word."""
    out = np.zeros((len(offsets) - 1, SIZE))
    for i, j in runs(offsets, PIECE):
        bucket, doc = stream(data, offsets, i, j)
        if not len(bucket):
            continue
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        many = np.diff(np.append(first, len(doc)))
        for a in range(0, len(first), 16):
            lo, hi = first[a], first[a + 16] if a + 16 < len(first) else len(doc)
            out[i + doc[first[a : a + 16]]] = np.add.reduceat(vectors[bucket[lo:hi]], first[a : a + 16] - lo, axis=0, dtype=np.float64)
        out[i + doc[first]] /= many[:, None]
    return out


def _pooled(batches, vectors: np.ndarray):
    let_go()
    for batch in batches:
        x = pool(vectors, *text_buffer(batch.column("text"))).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"]
        )


@dataclass
class Network:
    """Two layers; scores are divided by a temperature before the logistic function."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.first + self.bias)
        return hidden @ self.second + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, decay: float = 1e-3) -> Network:
    """Network fitted on four fifths of the rows and calibrated on the rest.

    Without rows of both labels the score is the share of label 1 (one half without any row).
    """
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    x, y = x[order], y[order].astype(float)
    cut = len(y) - len(y) // 5
    if len(y) < 5 or len(set(y[:cut].tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        zero = np.zeros(x.shape[1])
        return Network(zero, zero + 1, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    mean, scale = x[:cut].mean(0), x[:cut].std(0) + 1e-6
    net = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    z = (x - mean) / scale
    step = 0
    for _ in range(rounds):
        mixed = rng.permutation(cut)
        for a in range(0, cut, 128):
            rows = mixed[a : a + 128]
            inner = np.tanh(z[rows] @ net[0] + net[1])
            out = 1 / (1 + np.exp(-np.clip(inner @ net[2] + net[3], -40, 40)))
            gap = (out - y[rows]) / len(rows)
            back = np.outer(gap, net[2]) * (1 - inner**2)
            grads = [z[rows].T @ back + decay * net[0], back.sum(0), inner.T @ gap + decay * net[2], gap.sum(keepdims=True)]
            step += 1
            for p, g, (m, v) in zip(net, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g**2 - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    found = Network(mean, scale, net[0], net[1], net[2], float(net[3][0]))
    margins, truth = found.margin(x[cut:]), y[cut:]
    if len(truth):
        tried = np.geomspace(0.25, 8, 41)
        loss = [np.logaddexp(0, np.where(truth > 0, -margins, margins) / t).mean() for t in tried]
        found.temperature = float(tried[int(np.argmin(loss))])
    return found


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and network out of at most ``most`` labelled documents outside the held-out fifth.

    The driver holds one vector per sampled document and a table of fixed size.
    """
    sample = training_sample(docs, labels, label, most)
    vectors = word_vectors(sample)
    rows = sample.mapInArrow(partial(_pooled, vectors=vectors), "doc_id bigint, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float).reshape(len(rows), SIZE)
    return vectors, fit_network(x, np.array([r["label"] for r in rows], int))


def _scored(batches, model, text: str, column: str):
    vectors, network = model
    let_go()
    for batch in batches:
        score = network.score(pool(vectors, *text_buffer(batch.column(text))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, column])


def with_quality(docs: DataFrame, model, column: str, text: str = "text") -> DataFrame:
    """Documents with an added score from 0 to 1, higher where label 1 is likelier.

    Whole texts are read, nothing else.  Null and empty texts get the score of a document without words.  All rows
    and columns stay; the model reads neither ids, languages nor sources.
    """
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(partial(_scored, model=model, text=text, column=column), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score at least ``threshold``) of every document.

    Repeated rows get equal scores; a null id is never held out.  Without usable labels every score is one half; an
    empty table gives an empty one.
    """
    scored = with_quality(texts(docs), fit_quality(docs, labels, **options), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Documents with a score of at least ``threshold``, all columns."""
    column = fresh(docs, "quality_score")
    scored = with_quality(docs, fit_quality(docs, labels, **options), column)
    return scored.filter(F.col(column) >= threshold).select(*docs.columns)
