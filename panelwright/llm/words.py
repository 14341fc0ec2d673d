"""Words, lines and their hashes over whole Arrow batches of texts, with numpy.

A slice of some rows is one byte array; words, windows and lines are ranges of it. The hash of a
range is a polynomial over its values modulo the prime 2 ** 61 - 1, taken from running sums, so that
every window of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: A prime, and two independent bases of polynomials modulo it.
PRIME = (1 << 61) - 1
BASES = (0x0F3779B97F4A7C15, 0x0B1CE4E5B9BF5847)
_ODD = 0x9E3779B97F4A7C15
_P, _LOW, _29, _32, _61 = np.uint64(PRIME), np.uint64((1 << 32) - 1), np.uint64(29), np.uint64(32), np.uint64(61)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
_tables: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`, and of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
UNBLANK = np.ones(256, bool)
UNBLANK[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit integers modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2 ** 32 for x below 2 ** 61, under 2 ** 62 and equal modulo the prime."""
    return (x >> _29) + ((x & np.uint64((1 << 29) - 1)) << _32)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of integers below it."""
    a_high, a_low, b_high, b_low = a >> _32, a & _LOW, b >> _32, b & _LOW
    low = a_low * b_low
    return _reduced(((a_high * b_high) << np.uint64(3)) + _shifted(a_high * b_low + a_low * b_high) + (low & _P) + (low >> _61))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo the prime."""
    table = _tables.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        step = np.full(len(table), pow(base, len(table), PRIME), np.uint64)
        table = np.concatenate([table, _times(table, step)])
    _tables[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit hash of each ``values[start:end]``.

    Two unlike ranges of up to n values share it for at most n in 2 ** 61 of all bases, whatever they
    hold; ``base`` picks one of two independent ones.
    """
    up = powers(BASES[base], len(values))
    if values.dtype == np.uint8 and len(values) < 1 << 22:  # small enough to sum up both halves of each product as they are
        at = values.astype(np.uint64) + np.uint64(1)
        low, high = at * (up & _LOW), at * (up >> _32)
    else:
        at = _times(_reduced(values.astype(np.uint64) + np.uint64(1)), up)
        low, high = at & _LOW, at >> _32
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(low, out=sums[0, 1:])
    np.cumsum(high, out=sums[1, 1:])
    low, high = sums[0][end] - sums[0][start], sums[1][end] - sums[1][start]
    found = _reduced(_reduced(low) + _shifted(_reduced(high)))
    back = powers(pow(BASES[base], -1, PRIME), int(start.max(initial=0)) + 1)[start]
    return mix(_times(found, back) + (end - start).astype(np.uint64) * _LENGTH)


def gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the gram of ``size`` bytes at every place: fast, and good enough to order short grams, not to tell them apart."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up = np.full(len(data), _ODD, np.uint64)
    up[0] = 1
    np.cumprod(up, out=up)
    down = np.full(len(data) - size + 1, pow(_ODD, -1, 1 << 64), np.uint64)
    down[0] = 1
    np.cumprod(down, out=down)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of rows of about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one more at the end)."""
    is_word = inside[data]
    begins, ends = is_word.copy(), is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends[:-1] &= ~is_word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= is_word[edges]
    ends[edges - 1] |= is_word[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def windows(first: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the windows of ``n`` words within a row, and their rows."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][rows]
    return begin, rows


def find_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the lines between \n, and the row of each."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
    return start, end, np.repeat(np.arange(len(per_row)), per_row)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: keys that occur twice or more; occurrences after the first in order."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later
