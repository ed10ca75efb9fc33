"""Words of many texts packed into one buffer, and XXH64 of spans of it, in numpy over whole Arrow batches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_BY_LIBRARY = 256  # spans longer than this are hashed one by one


class Packed(NamedTuple):
    """Lower-cased words, each followed by one space; byte places in ``source`` are those of the texts' bytes."""

    buffer: np.ndarray
    start: np.ndarray
    length: np.ndarray
    source: np.ndarray
    first: np.ndarray  # first word of each text, with a closing end

    def spans(self, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the words ``at`` to ``last``, both included, joined by single spaces."""
        return self.start[at], self.start[last] + self.length[last] - self.start[at]


def packed_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Packed:
    """Words are maximal runs, within a text, of bytes that ``word`` marks; only A-Z are lower-cased."""
    n = len(data)
    inside = word[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    source = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:-1][offsets[1:-1] > 0] - 1] = False
    length = np.flatnonzero(inside & ~after) + 1 - source
    start = np.zeros(len(length), dtype=np.int64)
    np.cumsum(length[:-1] + 1, out=start[1:])
    total = int(start[-1] + length[-1] + 1) if len(length) else 0
    buffer = np.full(total + 8, 32, dtype=np.uint8)
    held = np.ones(total, dtype=bool)
    if len(length):
        held[start + length] = False
    buffer[:total][held] = _LOWER[data[inside]]
    return Packed(buffer, start, length, source, np.searchsorted(source, offsets))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _stirred(lane: np.ndarray) -> np.ndarray:
    return _rotated(lane * _P2, 31) * _P1


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every span of ``buffer``, which must end with eight spare bytes."""
    n = len(buffer)
    lanes = np.ndarray((n - 7,), "<u8", buffer=buffer, strides=(1,))
    halves = np.ndarray((n - 3,), "<u4", buffer=buffer, strides=(1,))
    at = start.astype(np.int64, copy=True)
    left = np.where(length > _BY_LIBRARY, 0, length)
    origin = np.full(1, seed, dtype=np.uint64)
    h = np.repeat(origin + _P5, len(at))
    wide = np.flatnonzero(left >= 32)
    if len(wide):
        v = [np.repeat(x, len(wide)) for x in (origin + _P1 + _P2, origin + _P2, origin, origin - _P1)]
        live = np.arange(len(wide))
        while len(live):
            place = at[wide[live]]
            for k in range(4):
                v[k][live] = _rotated(v[k][live] + lanes[place + 8 * k] * _P2, 31) * _P1
            at[wide[live]] += 32
            left[wide[live]] -= 32
            live = live[left[wide[live]] >= 32]
        mixed = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
        for x in v:
            mixed = (mixed ^ _stirred(x)) * _P1 + _P4
        h[wide] = mixed
    h += length.astype(np.uint64)
    rest = np.flatnonzero(left >= 8)
    while len(rest):
        h[rest] = _rotated(h[rest] ^ _stirred(lanes[at[rest]]), 27) * _P1 + _P4
        at[rest] += 8
        left[rest] -= 8
        rest = rest[left[rest] >= 8]
    rest = np.flatnonzero(left >= 4)
    h[rest] = _rotated(h[rest] ^ (halves[at[rest]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[rest] += 4
    left[rest] -= 4
    rest = np.flatnonzero(left > 0)
    while len(rest):
        h[rest] = _rotated(h[rest] ^ (buffer[at[rest]].astype(np.uint64) * _P5), 11) * _P1
        at[rest] += 1
        left[rest] -= 1
        rest = rest[left[rest] > 0]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(length > _BY_LIBRARY).tolist():
        h[i] = xxhash.xxh64_intdigest(buffer[start[i]:start[i] + length[i]].data, seed=seed)
    return h
