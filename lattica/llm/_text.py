"""Whole-column text primitives over Arrow buffers.

Texts stay in the column's UTF-8 buffer: word bounds, hashes and n-grams of all
rows of a block come from a few NumPy passes instead of a Python loop.  Memory
is bounded by ``BLOCK_BYTES`` or, if larger, by one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_pow = {"n": 0}

#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, by byte.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_blocks(batches, column="text", block_bytes=BLOCK_BYTES):
    """Yields (rows, bytes, offsets) for runs of rows of at most ``block_bytes``, or one row."""
    for batch in batches:
        data, off = string_buffers(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, "right")) - 1))
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def word_bounds(data, offsets, is_word):
    """Starts and ends of all words, and for each row the index of its first word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = w.copy()
    starts[1:] &= ~w[:-1] | edge[1:-1]
    ends = w
    ends[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n):
    if _pow["n"] < n:
        n = max(n, _CHUNK)
        with np.errstate(over="ignore"):
            for k, b in (("p", _BASE), ("i", _INV)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                _pow[k] = np.multiply.accumulate(a)
        _pow["n"] = n
    return _pow["p"], _pow["i"]


def mix(x):
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def span_hashes(data, starts, ends, lower=True):
    """64-bit hashes of the byte spans, which are in ascending order; ``lower`` folds A-Z."""
    table = _LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            s0 = int(starts[i])
            j = min(n, max(i + 1, int(np.searchsorted(ends, s0 + _CHUNK, "right"))))
            e1 = int(ends[j - 1])
            p, inv = _powers(e1 - s0 + 1)
            h = np.zeros(e1 - s0 + 1, np.uint64)
            np.cumsum(table[data[s0:e1]] * p[: e1 - s0], out=h[1:])
            s, e = starts[i:j] - s0, ends[i:j] - s0
            out[i:j] = (h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            i = j
    return mix(out)


def chain(a, b):
    """An order-dependent hash of two hashes."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9FB21C651E98DF25) + b + np.uint64(0x2545F4914F6CDD1D))


def row_of(bounds):
    """For rows that own items bounds[i]:bounds[i+1], the row of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
