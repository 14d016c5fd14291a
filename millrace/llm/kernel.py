"""Vectorised text kernels over a slice of texts held as one byte array and offsets."""

from __future__ import annotations

import numpy as np
import xxhash

_SEED = 20240229
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
BYTE_HASH = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_HASH_2 = np.random.default_rng(_SEED + 1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~IS_SPACE
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, key: str, n: int) -> np.ndarray:
    table = _powers.get(key)
    if table is None or len(table) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
        if size <= 1 << 23:
            _powers[key] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes any span's polynomial hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(table[data] * _power_table(_BASE, "p", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Raw hash of each span; equal spans have equal values wherever they stand."""
    inverse = _power_table(_INV, "i", len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all maximal runs of non-space bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = IS_WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def byte_windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, without a copy; data must have eight bytes to spare."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 512


def span_digest(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; equal spans have equal values wherever they stand.

    Eight bytes at a time pass through a mixing step that is not linear, so no family of words meets by its structure, as
    it may under sums of powers. Spans of over ``LONG_SPAN`` bytes are hashed one by one by xxh3.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_BASE))
    view = byte_windows(np.concatenate([data, np.zeros(8, np.uint8)]))
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].data)
    rows = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(rows):
        left = size[rows] - at
        part = view[start[rows] + at] & _HEAD[np.minimum(left, 8)]
        out[rows] = mix((out[rows] ^ part) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(_BASE))
        at += 8
        rows = rows[left > 8]
    return out


def counts_by_text(text_no: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text_no, minlength=n)[:n].astype(np.int64)


def sum_by_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def word_windows(hashes: np.ndarray, text_no: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text, and the number of its first word."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for k in range(width):
        total += hashes[k : k + m] * np.uint64(pow(_BASE, 2 * k + 1, 1 << 64))
    inside = np.flatnonzero(text_no[:m] == text_no[width - 1 :])
    return mix(total[inside]), inside
