"""Helpers shared by the operators: tables, scratch tables, text batches and word shingles.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` after lower-casing A-Z. Shingles are hashed to 64
bits with numpy over whole Arrow batches, so no step works word by word in Python.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import settle, shared_path

__all__ = ["table", "settle", "shared_path", "text_chunks", "bytes_of", "word_hashes", "word_places", "shingles_of", "mix", "SHINGLE", "in_shuffle_partitions",
           "hashed_sample", "give_back", "tidy", "drop_kept", "kept_table"]

SHINGLE = 5
CHUNK_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, hash_: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, the first by a hash; tasks send on only about twice as many in all."""
    share = min(1.0, 2 * limit / max(df.count(), 1))
    drawn = df.withColumn("drawn_", F.pmod(hash_, F.lit(1 << 30)))
    return drawn.filter(F.col("drawn_") < math.ceil(share * (1 << 30))).orderBy("drawn_").limit(limit).drop("drawn_")


def give_back() -> None:
    """Return freed memory of this worker to the system: a worker serves many tasks, and what one has used adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives memory back at its end, when its own variables, the last batch among them, are gone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


_kept: dict[str, Any] = {}


def drop_kept() -> None:
    """Forget what earlier tasks have kept in this worker."""
    _kept.clear()
    give_back()


def kept_table(name: Hashable, make: Callable[[], Any]) -> Any:
    """A table that a worker keeps from task to task. It keeps one: workers serve all stages of a job, so that of another
    operator is dropped first."""
    if _kept.get("name") != name:
        drop_kept()
        _kept.update(name=name, table=make())
    return _kept["table"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of whole rows with about ``limit`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_places(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every lower-cased word; ``word`` tells which bytes are part of one."""
    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=padded[:n])
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = word[data]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = inside[1:]
    cut = offsets[1:-1][offsets[1:-1] > 0] - 1
    after[cut] = False
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    lanes = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix((lanes[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD[0])
    rest, k = np.flatnonzero(lengths > 8), 8
    while len(rest):
        left = lengths[rest] - k
        h[rest] = mix(h[rest] * _ODD[1] + (lanes[starts[rest] + k] & _MASK[np.minimum(left, 8)]))
        k += 8
        rest = rest[left > 8]
    return h, starts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, first word of each text with a closing end)."""
    data, offsets = bytes_of(column)
    h, starts = word_places(data, offsets)
    return h, np.searchsorted(starts, offsets)


def shingles_of(words: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle in text order, first shingle of each text with a closing end).

    A text of 1 to k-1 words is one shingle of its whole word sequence; a text without words has none.
    """
    count = np.diff(first)
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rolled[: n - j if j else n] += words[j:] * _ODD[j % 5] if n > j else 0
    short = np.flatnonzero((count > 0) & (count < k))
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], per)
    out = mix(rolled[at]) if len(at) else np.zeros(0, np.uint64)
    for d in short:
        total = np.uint64(count[d])
        for j in range(count[d]):
            total = total + words[first[d] + j:first[d] + j + 1] * _ODD[j % 5]
        out[ends[d]] = mix(mix(total))[0]
    return out, ends
