"""Hashes of byte spans, words and shingles, for all texts of a batch at once.

The hash of a span is a polynomial over a random value per byte, modulo 2**64, taken from prefix sums, so that
any span costs two look-ups.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19
_SEED = 20260101
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(_SEED)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Every byte but blank, tab, line ends and their like belongs to a word.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0

#: Letters and digits (and all bytes of longer code points) belong to a word, marks part words.
PLAIN_WORDS = np.zeros(256, np.uint8)
PLAIN_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grow(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def powers(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(PIECE + 1024, n)
        _powers[:] = [_grow(_BASE, size), _grow(pow(_BASE, -1, 1 << 64), size)]
    return _powers


def prefix(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span(sums: np.ndarray, start, end) -> np.ndarray:
    """Hash of every span ``start`` to ``end``; both are index arrays or slices of equal length."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def _tokens(data: np.ndarray, firsts: np.ndarray, classes: np.ndarray, sums: bool):
    kind = classes[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[firsts] = True
    at = np.flatnonzero(edge)
    full = kind[at] > 0
    start, end = at[full], np.append(at[1:], len(data))[full]
    total = prefix(LOWER[data])
    return start, end, kind[start], span(total, start, end), total if sums else None


def tokens(data: np.ndarray, offsets: np.ndarray, i: int, j: int, classes: np.ndarray):
    """Tokens of texts i to j-1: number of the text (from 0), class, hash without case, start and end in ``data``.

    A token is a run of bytes of one class above 0.  A text of many pieces is cut behind a byte of class 0.
    """
    out = []
    a, end = int(offsets[i]), int(offsets[j])
    while a < end:
        b = min(a + PIECE, end)
        if b < end and j - i == 1:
            gaps = np.flatnonzero(classes[data[a:b]] == 0)
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                step = PIECE
                while b < end:
                    gaps = np.flatnonzero(classes[data[b : b + step]] == 0)
                    if len(gaps):
                        b += int(gaps[0]) + 1
                        break
                    b = min(b + step, end)
        elif b < end:
            b = end
        firsts = offsets[i : j + 1] - a
        firsts = firsts[(firsts >= 0) & (firsts < b - a)]
        s, e, k, h, _ = _tokens(data[a:b], firsts, classes, False)
        out.append((s + a, e + a, k, h))
        a = b
    if not out:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint8), none.astype(np.uint64), none, none
    s, e, k, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(offsets[i : j + 1], s, "right") - 1, k, h, s, e


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5):
    """Hash and text of every shingle; a text with fewer words is one shingle as a whole."""
    count = np.bincount(doc, minlength=n_docs)
    ends = np.cumsum(count)
    n = max(len(h) - size + 1, 0)
    whole = np.flatnonzero(np.arange(n) + size <= ends[doc[:n]])
    total = np.full(len(whole), size, np.uint64)
    for k in range(size):
        total += h[whole + k] * _PLACE[k]
    few = np.flatnonzero((count > 0) & (count < size))
    first = ends[few] - count[few]
    short = count[few].astype(np.uint64)
    for k in range(size - 1):
        held = count[few] > k
        short[held] += h[first[held] + k] * _PLACE[k]
    return np.concatenate([mix(total), mix(short)]), np.concatenate([doc[whole], few])


def pairs(h: np.ndarray) -> np.ndarray:
    """Hash of every word and the next."""
    return mix(h[:-1] * _PLACE[40] + h[1:] * _PLACE[41])
