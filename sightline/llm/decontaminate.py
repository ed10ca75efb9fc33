"""Benchmark decontamination by SimHash of item-sized windows (operator 7).

A window of a document has as many words as a benchmark item (a shorter document is one window). Windows and items
have SimHash fingerprints of 128 bits over their word shingles. A multi-index finds, for each window, all items of its
size within Hamming distance ``RADIUS``; the second and later occurrences of a shingle count as shingles of their own, so that
repeats weigh no more than others. Split into eight blocks of 16 bits, two such fingerprints have a block that
differs in at most ``RADIUS // 8`` bits, and every item is filed under all such neighbours of its blocks. Candidates are
verified exactly: the weighted Jaccard similarity of the shingles, weighted by how often they occur, is ``NEAR`` or
more. At that similarity a fingerprint differs in 19 bits on average with a deviation of 4, so ``RADIUS`` is four
deviations away; equal texts differ in none.

Only windows in which 8/9 of the shingles occur in some item can be that similar, so others are not fingerprinted; that
loses nothing.

Defined cases: null and wordless texts and items match nothing; an item of fewer than five words is one shingle of all its
words and matches windows of as many words; a null key stays null; repeated rows each give their matches; other columns
are ignored by ``matches`` and kept by ``clean``. The items are a query set: they are sent to the tasks in blocks of
``MAX_ITEMS``, one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import SHINGLE, give_back, kept_table, mix, shingles_of, table, text_chunks, tidy, word_hashes

NEAR = 0.8
RADIUS = 36
BLOCKS = 8
MAX_ITEMS = 1_200  # of one block: an item is filed 20 000 times, 80 kB, in the index of every worker
SEGMENT = 4096
PROBED = 1 << 18  # (window, item) pairs looked at in one step
CHUNK = 2 << 20


def _near_masks() -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(16), k)],
                    dtype=np.uint16)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of every shingle."""
    both = np.stack([mix(shingles), mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], axis=1).astype("<u8")
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(how many equal ones are before each, first place of its kind in sorted order, sorted (kind, position) keys)."""
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    head = np.searchsorted(shingles[order], shingles[order])
    before, kind = np.empty(n, np.int64), np.empty(n, np.int64)
    before[order], kind[order] = np.arange(n) - head, head
    return before, kind, head * (n + 1) + order


def _occurrence(shingles: np.ndarray, before: np.ndarray) -> np.ndarray:
    return shingles ^ (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def numbered(shingles: np.ndarray) -> np.ndarray:
    """(shingle, occurrence number) pairs as one number each; first occurrences are the shingles themselves."""
    return _occurrence(shingles, _places(shingles)[0])


def window_sums(shingles: np.ndarray, span: int) -> np.ndarray:
    """Sums of the signs of the numbered shingles of every window of ``span`` shingles."""
    before, kind, keys = _places(shingles)
    n = len(shingles)
    if not before.any():
        sums = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(signs(shingles), axis=0, dtype=np.int32)])
        return sums[span:] - sums[:-span]

    def count(at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Shingles equal to the ones at ``at`` before position ``limit``."""
        return np.searchsorted(keys, kind[at] * (n + 1) + limit) - kind[at]

    # The window moves on by one: the last number of the shingle that leaves goes, the next of the one that enters comes.
    out = np.arange(n - span)
    into = out + span
    gone = _occurrence(shingles[out], count(out, into) - before[out] - 1)
    come = _occurrence(shingles[into], before[into] - count(into, out + 1))
    first = signs(numbered(shingles[:span])).sum(axis=0, dtype=np.int32, keepdims=True)
    return np.cumsum(np.concatenate([first, signs(come) - signs(gone)]), axis=0, dtype=np.int32)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


class ItemIndex:
    """Fingerprints of a block of items, filed under the neighbours of their 16-bit blocks, by number of words."""

    def __init__(self, sizes: np.ndarray, shingles: list[np.ndarray]):
        self.sizes, self.shingles = sizes, shingles
        self.known = np.unique(np.concatenate(shingles))
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.concatenate([fingerprints(signs(numbered(s)).sum(axis=0, keepdims=True)) for s in shingles])
        self.lengths = np.unique(sizes)
        near = _near_masks()
        self.items = [np.flatnonzero(sizes == size) for size in self.lengths.tolist()]
        self.keys = [self._filed(self.prints[own], near) for own in self.items]

    @staticmethod
    def _filed(prints: np.ndarray, near: np.ndarray) -> np.ndarray:
        """For each block the sorted (neighbour, place of the item among those of its size) entries, one number each."""
        kind = np.uint32 if len(prints) <= 1 << 16 else np.uint64
        bits = kind(np.dtype(kind).itemsize * 4)
        out = np.empty((BLOCKS, len(prints) * len(near)), kind)
        place = np.arange(len(prints), dtype=kind)[:, None]
        for block in range(BLOCKS):
            np.bitwise_or((prints[:, block, None] ^ near).astype(kind) << bits, place, out=out[block].reshape(len(prints), len(near)))
            out[block].sort()
        return out

    def has(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles occur in some item."""
        hit = self.table[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = np.isin(shingles[at], self.known)
        return hit

    def candidates(self, prints: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of one size within ``RADIUS``."""
        own, keys = self.items[rank], self.keys[rank]
        bits = keys.dtype.type(keys.dtype.itemsize * 4)
        low = keys.dtype.type((1 << int(bits)) - 1)
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, PROBED // len(own))
        for part in range(0, len(prints), step):
            near = prints[part:part + step]
            met = []
            for block in range(BLOCKS):
                key = near[:, block].astype(keys.dtype) << bits
                a, b = np.searchsorted(keys[block], key), np.searchsorted(keys[block], key | low, side="right")
                count = b - a
                w = np.repeat(np.arange(len(near)), count)
                at = np.arange(len(w)) + np.repeat(a - (np.cumsum(count) - count), count)
                met.append(w * len(own) + (keys[block][at] & low).astype(np.int64))
            pairs = np.unique(np.concatenate(met))
            w, i = pairs // len(own), own[pairs % len(own)]
            close = np.bitwise_count(near[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
            windows.append(w[close] + part)
            items.append(i[close])
        return np.concatenate(windows), np.concatenate(items)

    def matches(self, shingles: np.ndarray, words: int, width: int) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of the best window of every item that a text holds.

        ``shingles`` are those of the text in order, each of ``width`` words; ``words`` is its length.
        """
        hit = self.has(shingles)
        if not hit.any():
            return []
        upto = np.concatenate([[0], np.cumsum(hit)])
        best: dict[int, tuple[float, int]] = {}
        for rank, size in enumerate(self.lengths.tolist()):
            if min(size, SHINGLE) != width:
                continue
            span = min(size, words) - width + 1
            starts = np.arange(len(shingles) - span + 1)
            starts = starts[9 * (upto[starts + span] - upto[starts]) >= 8 * span]
            for part in range(0, len(starts), SEGMENT):
                own = starts[part:part + SEGMENT]
                cuts = np.flatnonzero(np.diff(own) > span) + 1
                for run in np.split(own, cuts):
                    low, high = run[0], run[-1] + span
                    prints = fingerprints(window_sums(shingles[low:high], span)[run - low])
                    for w, i in zip(*(x.tolist() for x in self.candidates(prints, rank))):
                        score = weighted_similarity(shingles[run[w]:run[w] + span], self.shingles[i])
                        if score >= NEAR and (i not in best or score > best[i][0]):
                            best[i] = (score, int(run[w]))
        return [(i, at, score) for i, (score, at) in sorted(best.items())]


def _build(texts: tuple[str, ...]) -> tuple[ItemIndex, np.ndarray] | None:
    words, first = word_hashes(pa.array(texts, pa.string()))
    count = np.diff(first)
    held = np.flatnonzero(count)
    if not len(held):
        return None
    by_width = {w: shingles_of(words, first, w) for w in {min(int(n), SHINGLE) for n in count[held]}}
    own = [by_width[min(int(count[i]), SHINGLE)] for i in held.tolist()]
    return ItemIndex(count[held], [s[ends[i]:ends[i + 1]] for i, (s, ends) in zip(held.tolist(), own)]), held


def _index(texts: tuple[str, ...]) -> tuple[ItemIndex, np.ndarray] | None:
    def make() -> tuple[ItemIndex, np.ndarray] | None:
        built = _build(texts)
        give_back()
        return built

    return kept_table(("items", texts), make)


def _text_matches(column: pa.Array, texts: tuple[str, ...]) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, first word, similarity) for a batch of texts."""
    built = _index(texts)
    if built is None:
        return
    index, held = built
    words, first = word_hashes(column)
    count = np.diff(first)
    for width in sorted({min(int(s), SHINGLE) for s in index.lengths}):
        shingles, ends = shingles_of(words, first, width)
        hits = np.concatenate([[0], np.cumsum(index.has(shingles))])
        for row in np.flatnonzero((hits[ends[1:]] > hits[ends[:-1]]) & (count >= width)).tolist():
            for item, at, score in index.matches(shingles[ends[row]:ends[row + 1]], int(count[row]), width):
                yield row, int(held[item]), at, score


def _item_blocks(items: DataFrame, item: str, text: str) -> Iterator[tuple[list, tuple[str, ...]]]:
    """The items in blocks of about ``MAX_ITEMS``."""
    plain = items.select(items[item].alias("item"), F.coalesce(items[text], F.lit("")).alias("text"))
    blocks = max(1, -(-plain.count() // MAX_ITEMS))
    for block in range(blocks):
        rows = plain.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        yield [r["item"] for r in rows], tuple(r["text"] for r in rows)


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """(key, item, start_word, similarity): the best window of every document for each item that it holds."""
    kind = items.schema[item].dataType.simpleString()
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    schema = f"key {plain.schema['key'].dataType.simpleString()}, item {kind}, start_word bigint, similarity double"
    out = None
    for ids, texts in _item_blocks(items, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            for batch in text_chunks(batches, "text", CHUNK):
                found = list(_text_matches(batch.column(1), texts))
                if found:
                    rows, item_at, start, score = zip(*found)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)), pa.array([ids[i] for i in item_at]),
                        pa.array(start, pa.int64()), pa.array(score, pa.float64()),
                    ], names=["key", "item", "start_word", "similarity"])

        part = plain.mapInArrow(tidy(work), schema)
        out = part if out is None else out.union(part)
    return out.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no item; one pass without a shuffle for each block of items."""
    out = docs
    for _, texts in _item_blocks(items, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(texts)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches, text, CHUNK):
                kept = np.ones(batch.num_rows, dtype=bool)
                column = batch.column(batch.schema.get_field_index(text))
                kept[[row for row, *_ in _text_matches(column, sent.value)]] = False
                yield batch.filter(pa.array(kept))

        out = out.mapInArrow(tidy(work), out.schema)
    return out


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_simhash_decontamination": op7_simhash_decontamination}
ORACLES: dict[str, str] = {}
