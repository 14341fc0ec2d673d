"""Order of suffixes by the difference cover of size three, with numpy."""

from __future__ import annotations

import numpy as np


def _names(key: np.ndarray) -> np.ndarray:
    """Ranks of the keys from 1 on; equal keys share one."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes at each place as a number; bytes after the end are 0."""
    padded = np.zeros(n + 8, np.uint64)
    padded[: len(data)] = data
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : n + k]
    return out


def _sample_names(data: np.ndarray, length: int) -> np.ndarray:
    """A name for each place at 1 and 2 modulo 3, (row, place // 3), that orders the sample by ``length`` bytes or more.

    Words of eight bytes give the first names. Names at equal steps make triples, and sorted triples
    give the next names, which reach three times as far; the step is a multiple of three, so a triple
    stays in the sample.
    """
    rows = len(data) // 3 + 1
    name = _names(_words(data, 3 * rows + 3)[: 3 * rows].reshape(rows, 3)[:, 1:].T.reshape(-1)).reshape(2, rows)
    reach = 8
    while reach < length and int(name.max()) < name.size:
        bits = int(name.max()).bit_length()
        n_parts = 2 if 3 * bits > 63 or 2 * reach >= length else 3
        step = min(reach // 3, -(-(length - reach) // 3)) if n_parts == 2 else reach // 3
        padded = np.concatenate([name, np.zeros((2, 2 * step), np.int64)], axis=1)
        key = name
        for k in range(1, n_parts):
            key = (key << bits) | padded[:, k * step : k * step + rows]
        name = _names(key.reshape(-1)).reshape(2, rows)
        reach += (n_parts - 1) * step * 3
    return name


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """``starts`` in the order of the ``length`` bytes from each on (past the end: 0); equal strings are neighbours.

    Places at 1 and 2 modulo 3 are the sample, and its names order it. A start at 0 is a byte followed
    by a sampled place, or two bytes followed by one, so it compares with any sampled start by bytes and
    names: both sorted lists are merged by counting the sampled starts below each other one.
    """
    name = _sample_names(data, length)
    flat = np.concatenate([np.stack([np.zeros(name.shape[1], np.int64), *name], 1).reshape(-1), np.zeros(3, np.int64)])
    t = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
    bits = int(flat.max()).bit_length()
    by = [starts[starts % 3 == k] for k in range(3)]
    one = lambda p: (t[p] << bits) | flat[p + 1]
    two = lambda p: (((t[p] << 8) | t[p + 1]) << bits) | flat[p + 2]
    rest = by[0][np.argsort(two(by[0]))]
    sampled = np.concatenate(by[1:])
    sampled = sampled[np.argsort(flat[sampled])]
    below = np.searchsorted(np.sort(one(by[1])), one(rest)) + np.searchsorted(np.sort(two(by[2])), two(rest))
    place = np.arange(len(rest)) + below
    taken = np.zeros(len(starts), bool)
    taken[place] = True
    out = np.empty(len(starts), np.int64)
    out[place], out[~taken] = rest, sampled
    return out


def equal_neighbours(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each neighbouring pair of ``order`` starts with the same ``length`` bytes; all have that many."""
    words = _words(data, len(data))
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    if length < 8:
        shift = np.uint64(8 * (8 - length))
        alive = alive[words[left] >> shift == words[right] >> shift]
    else:
        for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            alive = alive[words[left[alive] + step] == words[right[alive] + step]]
    same = np.zeros(len(left), bool)
    same[alive] = True
    return same
