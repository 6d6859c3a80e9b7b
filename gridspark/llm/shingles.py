"""Word shingles of many texts at once, as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, SPACES, UPPER

#: Texts are hashed so many bytes at a time (a longer one alone).
CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_JOIN = _U(0xD1342543DE82EF95)
_fold = np.arange(256, dtype=np.uint8)
_fold[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
_space = np.zeros(256, bool)
_space[[ord(c) for c in SPACES]] = True
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n, _U(base), _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A to Z lower-cased. A text of fewer
    words, but not none, has its whole sequence as the one shingle; a null text
    and one without words have none.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        at = offsets[first : last + 1]
        yield from _sets_of(data[at[0] : at[-1]], at - at[0], k)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts laid end to end start and end."""
    n = len(data)
    space = breaks[data]
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = space
    before[offsets] = True
    after[:-1] = space
    after = np.append(after[1:], True)
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before[:n])
    return starts, np.flatnonzero(~space & after[:n]) + 1


def _words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and each text's first word."""
    starts, ends = word_spans(data, offsets, breaks)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    power, unpower = _grown(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * unpower[starts] + (ends - starts).astype(_U))


def _sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    words, edges = _words(_fold[data], offsets, _space)
    if len(words) >= k:
        joined = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            joined = joined * _JOIN + words[i : len(words) - k + 1 + i]
        joined = mixed(joined)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            h = b - a
            for w in words[a:b].tolist():
                h = (h * int(_JOIN) + w) & (1 << 64) - 1
            yield mixed(np.array([h], _U))
        else:
            yield np.zeros(0, _U)


def minhashes(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each odd factor, the low half of the least product with an item."""
    least = np.full(len(factors), np.iinfo(_U).max, _U)
    for i in range(0, len(items), 512):
        np.minimum(least, (items[None, i : i + 512] * factors[:, None]).min(axis=1), out=least)
    return least.astype("<u4")


def hashed_words(texts: pa.Array, breaks: np.ndarray, chunk: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: the 64-bit hashes of their words, one text after the
    other, and where each text's words begin (one more than texts). ``breaks``
    says of each byte value whether it stands between words; A to Z fold."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
        at = offsets[first : last + 1]
        yield _words(_fold[data[at[0] : at[-1]]], at - at[0], breaks)
        first = last
