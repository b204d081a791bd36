"""Words of Arrow text batches as numpy arrays.

Texts stay UTF-8 bytes: a separator table over the 256 byte values finds the
words of a whole batch at once.  Bytes from 0x80 up are parts of longer
characters and are never separators in the word rules used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of anything but ASCII white space (space, tab to carriage return).
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

_SEED = np.random.default_rng(0x7E4A)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INV_BASE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy unless it has nulls,
    which are empty texts."""
    a = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(a.type) else np.int32
    offsets = np.frombuffer(a.buffers()[1], width)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, width)
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS):
    """Start and end byte of every word of the rows that ``offsets`` bound
    (relative to the first), and the number of words before each row."""
    base = int(offsets[0])
    inside = ~separators[data[base:int(offsets[-1])]]
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets - base] = True
    before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
    after = np.concatenate((inside[1:], [False])) & ~cut[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets - base)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        if n <= 1 << 21:
            _powers[base] = p
    return p[:n]


def span_names(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of spans of 64-bit values; equal spans have equal names
    wherever they stand (prefix sums of a polynomial, shifted to zero)."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), dtype=np.uint64, out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _power(_INV_BASE, len(values) + 1)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of words given by byte spans of ``data``."""
    return span_names(_BYTE[data], start, end)
