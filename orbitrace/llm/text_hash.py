"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. A shingle is ``width`` consecutive words; a text with
fewer words, but at least one, has one shingle made of all its words; a text without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 22
#: Bytes that are hashed at a time, and places of a word with values of their own.
PART, PLACES = 1 << 17, 1 << 10
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words before each row (``n + 1`` counts)."""
    n = len(offsets) - 1
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the words, worked out by prefix sums over segments of at most a few MB.

    Long regular words can collide, so what uses these must compare the words themselves.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + SEGMENT)))
        part = raw[base : ends[j - 1]].astype(np.uint64)
        power, inverse = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part + np.uint64(1)) * power[: len(part)], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


@lru_cache(maxsize=1)
def _place_values() -> np.ndarray:
    """A scrambled value for every byte at every place of a word, modulo ``PLACES``: ``place << 8 | byte``."""
    return mix64(np.arange(1, (PLACES << 8) + 1, dtype=np.uint64) * np.uint64(_BASE))


def byte_word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of bytes: the sum of a scrambled value per byte and place in the word, scrambled again.

    A value has no algebraic relation to that of another place, so unlike a polynomial the sum collides by chance only,
    however long and regular the words are.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    values = _place_values()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PART, side="right")))
        a, b = starts[i:j] - base, ends[i:j] - base
        part = raw[base : base + b[-1]]
        head = np.zeros(len(part), dtype=np.int64)
        head[a] = a
        place = np.arange(len(part)) - np.maximum.accumulate(head)
        scrambled = values[(place & (PLACES - 1)) << 8 | part]
        if (b - a).max() > PLACES:
            scrambled = scrambled * (mix64((place >> 10).astype(np.uint64) * np.uint64(_BASE)) | np.uint64(1))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(scrambled, out=total[1:])
        out[i:j] = mix64(total[b] - total[a] + (b - a).astype(np.uint64) * _STEP)
        i = j
    return out


def shingle_hashes(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, in text order and with repeats, and ``n + 1`` offsets into them."""
    raw, offsets = utf8_buffer(column)
    starts, ends, before = word_spans(raw, offsets)
    words = byte_word_hashes(raw, starts, ends)
    count = np.diff(before)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(made)])
    if len(words) == 0:
        return np.zeros(0, np.uint64), out_off
    # position of the first word of every shingle
    first = np.repeat(before[:-1] - out_off[:-1], made) + np.arange(out_off[-1])
    short = np.repeat((count < width) & (count > 0), made)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    acc = padded[first].copy()
    left = np.repeat(count, made)
    for k in range(1, width):
        nxt = padded[first + k]
        if short.any():
            nxt = np.where(short & (left <= k), np.uint64(0), nxt)
        acc = acc * _STEP + nxt
    return mix64(acc), out_off


def distinct_shingles(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    values, off = shingle_hashes(column, width)
    return [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]


def permutations(k: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and increments of ``k`` universal hash permutations of 32-bit values."""
    rng = np.random.RandomState(seed)
    a = rng.randint(0, 1 << 32, size=k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.randint(0, 1 << 32, size=k, dtype=np.uint64).astype(np.uint32)
    return a, b


def minhash(values: np.ndarray, offsets: np.ndarray, k: int, seed: int = 20240229) -> np.ndarray:
    """``(n, k)`` matrix of minima, one column per permutation; a row without shingles holds the largest value.

    Repeated shingles do not change a minimum, so they need no removal. Work goes in slices of bounded size.
    """
    n = len(offsets) - 1
    out = np.full((n, k), 0xFFFFFFFF, dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    a, b = permutations(k, seed)
    full = np.flatnonzero(np.diff(offsets) > 0)
    i = 0
    while i < len(full):
        lo = offsets[full[i]]
        j = max(i + 1, int(np.searchsorted(offsets[full], lo + (1 << 16))))
        rows = full[i:j]
        part = x[lo : offsets[rows[-1] + 1]]
        heads = offsets[rows] - lo
        for p in range(k):
            out[rows, p] = np.minimum.reduceat(part * a[p] + b[p], heads)
        i = j
    return out


def scramble(signature: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` (8 or 16) of every scrambled minimum."""
    mixed = signature * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    return (mixed >> np.uint32(32 - bits)).astype(np.uint8 if bits == 8 else np.uint16)
