"""Words of whole Arrow batches at once: byte positions and 64-bit hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The multiplier of the polynomial hash; odd, so that it has an inverse modulo 2^64.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Marks all of ASCII that is neither letter nor digit.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes are hashed so many at a time, so that what is held beside a text doesn't grow with it.
SEGMENT = 1 << 16


@lru_cache(maxsize=1)
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the multiplier and of its inverse, up to those of a segment."""
    tables = []
    for base in (_BASE, _BASE_INVERSE):
        table = np.full(SEGMENT + 1, base, np.uint64)
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


class Words(NamedTuple):
    """Words of n_docs texts: byte ranges in `data`, the text each belongs to (not decreasing), and its hash."""

    data: np.ndarray
    doc_start: np.ndarray  # n_docs + 1 byte offsets
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n_docs + 1: the words of text i are first[i] to first[i + 1]

    @property
    def n_docs(self) -> int:
        return len(self.doc_start) - 1


def _edges(data: np.ndarray, doc_start: np.ndarray, breaks_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and byte after the last, of each word: words end at marked bytes and at the ends of texts."""
    size, starts, ends = len(data), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, size, SEGMENT):
        b = min(a + SEGMENT, size)
        gap = np.ones(b - a + 2, bool)  # with the byte before the segment and the byte after it
        low, high = max(a - 1, 0), min(b + 1, size)
        gap[low - a + 1:high - a + 1] = breaks_at[data[low:high]]
        new = np.zeros(b - a + 1, bool)
        new[doc_start[np.searchsorted(doc_start, a):np.searchsorted(doc_start, b, side="right")] - a] = True
        inside = ~gap[1:-1]
        starts.append(np.flatnonzero(inside & (gap[:-2] | new[:-1])) + a)
        ends.append(np.flatnonzero(inside & (gap[2:] | new[1:])) + a + 1)
    return np.concatenate(starts), np.concatenate(ends)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of each word, from the sums of the segments that it lies in."""
    power, inverse = _power_tables()
    sums = np.zeros(SEGMENT + 1, np.uint64)
    out = np.zeros(len(start), np.uint64)
    for a in range(0, len(data), SEGMENT):
        b = min(a + SEGMENT, len(data))
        low, high = int(np.searchsorted(end, a, side="right")), int(np.searchsorted(start, b))
        if low == high:
            continue
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[:b - a], out=sums[1:b - a + 1])
        s, e = np.maximum(start[low:high], a) - a, np.minimum(end[low:high], b) - a
        part = (sums[e] - sums[s]) * inverse[s]
        if start[low] < a:  # a word that began in an earlier segment goes on
            part[:1] *= np.array([pow(int(_BASE), int(a - start[low]), 1 << 64)], np.uint64)
        out[low:high] += part
    return mix(out + (end - start).astype(np.uint64) * _ODD)


def split_words(texts: pa.Array, lower: bool = True, breaks_at: np.ndarray = _IS_WHITE) -> Words:
    """Splits UTF-8 texts (no nulls) at the bytes marked in breaks_at, by default white space; A-Z are lower-cased if asked."""
    texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1, offset=8 * texts.offset)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    doc_start = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    start, end = _edges(data, doc_start, breaks_at)
    hashed = _hashes(data, start, end)
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Words(data, doc_start, start, end, doc, hashed, first)


@lru_cache(maxsize=8)
def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of each run of k words; a text of fewer words, but some, is one shingle of them all."""
    h, doc, n = words.hash, words.doc, len(words.hash)
    factors = _weights(k)
    if n >= k:
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out += h[j:n - k + 1 + j] * factors[j]
        whole = doc[k - 1:] == doc[:n - k + 1]
        out, of = mix(out[whole]), doc[:n - k + 1][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([mix((h[words.first[d]:words.first[d + 1]] * factors[:counts[d]]).sum(keepdims=True) + np.uint64(counts[d]))[0] for d in short], np.uint64)
        out, of = np.concatenate([out, own]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, their texts, and how often each occurs there."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def by_bytes(batch: pa.RecordBatch, text_column: int, most: int = 512 << 10, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows at most whose texts have about `most` bytes, or one row of more."""
    size = pc.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, base + most, side="right"))), at + rows)
        yield batch.slice(at, to - at)
        at = to


def texts_by_size(column: pd.Series, most: int = 256 << 10, rows: int = 1024) -> Iterator[pd.Series]:
    """Slices of a column of texts (no nulls) of about `most` characters and so many rows at most, or one row of more."""
    total, at = column.str.len().to_numpy(np.int64).cumsum(), 0
    while at < len(column):
        base = total[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(total, base + most, side="right"))), at + rows)
        yield column.iloc[at:to]
        at = to
