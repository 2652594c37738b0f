"""Dart-throwing signatures of weighted sets.

Every element owns the strip [0, weight) of a plane whose other axis is time. Hashing an element throws darts
into unit-area cells of its plane, one on average in each cell, at places that only the element and the cell
decide; darts above the element's weight miss. Each dart belongs to one coordinate. The signature holds, for
each coordinate, the earliest dart of all elements. Two sets share that dart with a probability equal to their
weighted Jaccard similarity. All weights together meet darts at a known rate, so looking at
(k ln k + 2 k) / total units of time fills nearly all k coordinates; those left empty are filled from later time.
"""

from __future__ import annotations

import numpy as np

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Cumulative probabilities of 0, 1, 2, ... darts in a cell of area 1 (Poisson, mean 1), as 32-bit thresholds.
_POISSON = (np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)])) * 2**32).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _throw(elements: np.ndarray, weights: np.ndarray, begin: float, end: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, times and identities of the darts that hit between two times."""
    out = []
    top, strip, low = float(weights.max()), 0, 0.0
    while low < top:
        width = 1.0 if strip == 0 else 2.0 ** (strip - 1)
        tall = 1.0 / width  # so that a cell has area 1
        own = elements if strip == 0 else elements[weights > low]
        reach = weights if strip == 0 else weights[weights > low]
        cells = np.arange(int(begin / tall), int(np.ceil(end / tall)), dtype=np.uint64)
        with np.errstate(over="ignore"):
            seed = mix(np.add.outer(own, mix(cells + np.uint64(strip << 48))))
        flat = seed.ravel()
        count = np.searchsorted(_POISSON, flat >> np.uint64(32), "right")
        cell = np.repeat(np.arange(len(flat)), count)  # one entry a dart
        nth = np.arange(1, len(cell) + 1) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            a = mix(flat[cell] + nth.astype(np.uint64) * _M1)
        place = low + width * ((a & np.uint64(0xFFFFFFFF)) / 2.0**32)
        when = (cells[cell % len(cells)] + (a >> np.uint64(32)) / 2.0**32) * tall
        good = np.flatnonzero((place < reach[cell // len(cells)]) & (when >= begin) & (when < end))
        b = mix(a[good])
        out.append(((b % np.uint64(k)).astype(np.int64), when[good], b))
        low, strip = low + width, strip + 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = 128) -> np.ndarray:
    """k 64-bit dart identities. Elements are distinct 64-bit hashes, weights positive (1 where not given); an empty set has none."""
    if weights is None:
        weights = np.ones(len(elements))
    elements, weights = elements[weights > 0], weights[weights > 0]
    if not len(elements):
        return np.zeros(0, np.uint64)
    out, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
    step = (k * np.log(k) + 2 * k) / float(weights.sum())
    begin = 0.0
    while not filled.all():
        coordinate, when, dart = _throw(elements, weights, begin, begin + step, k)
        order = np.argsort(when)[::-1]  # the earliest is written last
        first = np.zeros(k, np.uint64)
        got = np.zeros(k, bool)
        first[coordinate[order]] = dart[order]
        got[coordinate] = True
        new = got & ~filled
        out[new] = first[new]
        filled |= got
        begin += step
    return out
