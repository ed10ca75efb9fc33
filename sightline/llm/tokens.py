"""Pre-tokens of a byte-level BPE tokenizer, found for whole batches of texts with numpy, and a table of their ids.

The tokenizer cuts a text into pre-tokens and merges inside each of them alone, so every distinct pre-token needs to be
encoded once. Pre-tokens are told apart by a 64-bit hash of their bytes; a worker keeps the ids of known ones in
arrays (about 30 bytes a pre-token), which are dropped once they pass ``KEPT`` entries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

from sightline.llm.common import mix

KEPT = 1_500_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Endings that the pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern's ``\\p{L}``, ``\\p{N}`` and ``\\s`` have it."""
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            kinds[a:b] = kind
    return kinds


def _byte_classes(data: np.ndarray) -> np.ndarray:
    kinds = _classes()
    out = kinds[:256][data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        pad = np.concatenate([data, np.zeros(4, np.uint8)])
        lead = data[high].astype(np.uint32)
        c1, c2, c3 = (pad[high + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        point = np.where(lead < 0xE0, (lead & 0x1F) << 6 | c1, np.where(
            lead < 0xF0, (lead & 0x0F) << 12 | c1 << 6 | c2, (lead & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        kind, width = kinds[point], 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        for k in range(4):
            held = width > k
            out[high[held] + k] = kind[held]
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token in the UTF-8 bytes of several texts; ``offsets`` bound the texts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _byte_classes(data)
    cut = np.ones(n, dtype=bool)
    cut[1:] = kinds[1:] != kinds[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    cut[edge] = True
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    # White space before something else of the same text: its last character leaves the run, and joins what follows if it is a blank.
    run = np.flatnonzero(cut & (kinds == SPACE))
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)[np.searchsorted(starts, run)]
    followed = ~first[ends]
    ends = ends[followed]
    last = ends - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    cut[last] = True
    cut[ends[data[last] == 0x20]] = False
    # Endings after an apostrophe that starts a pre-token of its own.
    mark = np.flatnonzero((data == 0x27) & cut)
    if len(mark):
        pad = np.concatenate([data, np.zeros(2, np.uint8)])
        room = offsets[np.searchsorted(offsets, mark, side="right")] - mark
        open_ = np.ones(len(mark), dtype=bool)
        for ending in sorted(ENDINGS, key=len):
            hit = open_ & (room > len(ending))
            for k, letter in enumerate(ending, 1):
                hit &= pad[mark + k] == ord(letter)
            at = mark[hit]
            cut[at + 1] = False
            after = at + 1 + len(ending)
            cut[after[after < n]] = True
            open_ &= ~hit
    return np.flatnonzero(cut)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


class IdTable:
    """Ids of whole texts through ``encode_words``, which maps distinct pre-tokens to arrays of ids.

    ``encode_words`` takes the bytes and offsets of the pre-tokens and returns (ids, offsets). Special tokens are one id
    wherever their string stands; no other white space or letter joins them.
    """

    def __init__(self, encode_words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], specials: dict[str, int]):
        self.encode_words = encode_words
        self.specials = {t.encode(): i for t, i in specials.items()}
        self._drop()

    def _drop(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.where, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        found, raw = [], data.tobytes()
        for token, i in self.specials.items():
            at = raw.find(token)
            while at >= 0:
                text = np.searchsorted(offsets, at, side="right")
                if at + len(token) <= offsets[text]:
                    found.append((at, at + len(token), i))
                    at += len(token) - 1
                at = raw.find(token, at + 1)
        return sorted(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, first id of each text with a closing end)."""
        special = self._special_spans(data, offsets)
        cuts = np.array([x for a, b, _ in special for x in (a, b)], dtype=np.int64)
        bounds = np.unique(np.concatenate([offsets, cuts]))
        starts = pretokens(data, bounds)
        if special:
            keep = np.ones(len(starts), dtype=bool)
            for a, b, _ in special:
                keep[np.searchsorted(starts, a) + 1:np.searchsorted(starts, b)] = False
            starts = starts[keep]
        lengths = np.diff(np.append(starts, len(data)))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        h = mix((lanes[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rest, k = np.flatnonzero(lengths > 8), 8
        while len(rest):
            left = lengths[rest] - k
            h[rest] = mix(h[rest] * np.uint64(0xC2B2AE3D27D4EB4F) + (lanes[starts[rest] + k] & _MASK[np.minimum(left, 8)]))
            k += 8
            rest = rest[left > 8]
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        self._learn(data, distinct, starts[one], lengths[one])
        at = np.searchsorted(self.hashes, distinct)[back]
        where, count = self.where[at], self.length[at].astype(np.int64)
        ids = take_runs(self.ids, where, count)
        ends = np.concatenate([[0], np.cumsum(count)])
        firsts = ends[np.searchsorted(starts, offsets)]
        for a, _, i in special:
            t = np.searchsorted(starts, a)
            ids[ends[t]:ends[t + 1]] = i
        if special:
            drop = np.zeros(len(ids), dtype=bool)
            for a, _, _i in special:
                t = np.searchsorted(starts, a)
                drop[ends[t] + 1:ends[t + 1]] = True
            gone = np.concatenate([[0], np.cumsum(drop)])
            ids, firsts = ids[~drop], firsts - gone[firsts]
        return ids, firsts

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        if len(self.hashes) > KEPT:
            self._drop()
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            new = self.hashes[at] != hashes
            hashes, starts, lengths = hashes[new], starts[new], lengths[new]
        if not len(hashes):
            return
        words = take_runs(data, starts, lengths)
        ids, ends = self.encode_words(words, np.concatenate([[0], np.cumsum(lengths)]))
        where = ends[:-1] + len(self.ids)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        all_hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.where = np.concatenate([self.where, where])[order]
        self.length = np.concatenate([self.length, np.diff(ends).astype(np.int32)])[order]
