"""Token ids in word-aligned Simple-8b blocks (operator 10).

Format: a folder of Parquet files, written in ascending key order. A row is a block of whole documents with
``keys`` and ``lengths`` of its documents, ``n_ids``, ``part`` (file number), ``part_start`` (ids of that file before
the block), ``words`` (64-bit little-endian words) and ``escapes``. A word holds a selector in its top four bits and, in
the other 60, as many ids as the selector says, the first one lowest. Selector 0 is an escape: its payload is a place in
``escapes``, where values of 2^60 and more stand as they are. So every word can be read without its neighbours: a
block is decoded selector by selector with numpy, and the sizes in front of it give any document's place.

Defined cases: a null text counts as empty, so its only id is the end id; a null doc_id comes first; rows with the same
doc_id are ordered by a hash of their text, and repeated rows each have their own place. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.bpe import tokenizer_path
from sightline.llm.common import bytes_of, in_shuffle_partitions, shared_path, table, text_chunks
from sightline.llm.tokens import IdTable

END_ID = 2
BLOCK_IDS = 1 << 16
#: (ids in a word, bits of an id) by selector; selector 0 is the escape.
SELECTORS = ((1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
             (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPED = 1 << 60


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned values; greedy: every word takes as many of the next values as fit."""
    values = values.astype(np.uint64)
    n = len(values)
    out_of_range = values >= np.uint64(ESCAPED)
    place = np.cumsum(out_of_range) - 1
    chosen = np.full(n, 15, dtype=np.int8)
    width = np.searchsorted(np.array([1 << w for _, w in SELECTORS[1:]], dtype=np.uint64), values, side="right") + 1
    for s in range(14, 0, -1):
        count = SELECTORS[s][0]
        if n < count:
            continue
        over = np.concatenate([[0], np.cumsum(width > s, dtype=np.int32)])
        chosen[:n - count + 1][over[count:] == over[:n - count + 1]] = s
    chosen[out_of_range] = 0
    step = np.array([c for c, _ in SELECTORS])[chosen].tolist()
    at, heads = 0, []
    while at < n:
        heads.append(at)
        at += step[at]
    heads = np.array(heads, dtype=np.int64)
    selector = chosen[heads]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector).tolist():
        own = np.flatnonzero(selector == s)
        count, bits = SELECTORS[s]
        if s == 0:
            words[own] |= place[heads[own]].astype(np.uint64)
        elif bits:
            held = values[heads[own][:, None] + np.arange(count)]
            words[own] |= np.bitwise_or.reduce(held << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, values[out_of_range]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.array([c for c, _ in SELECTORS])[selector]
    ends = np.cumsum(count)
    out = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(selector).tolist():
        own = np.flatnonzero(selector == s)
        n, bits = SELECTORS[s]
        if s == 0:
            out[ends[own] - 1] = escapes[(words[own] & np.uint64(ESCAPED - 1)).astype(np.int64)]
        elif bits:
            shift = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            held = (words[own][:, None] >> shift) & np.uint64((1 << bits) - 1)
            out[(ends[own] - n)[:, None] + np.arange(n)] = held
    return out


class LibraryWords:
    """Ids of distinct pre-tokens from the tokenizers library.

    Pre-tokens that begin with a blank are joined to long strings, where each blank starts the next one again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = data.tobytes(), offsets.tolist()
        lengths = np.diff(offsets)
        blank = (data[offsets[:-1]] == 0x20) & (lengths > 1)
        blank &= data[np.minimum(offsets[:-1] + 1, len(data) - 1)] > 0x20
        counts, held = np.zeros(len(lengths), dtype=np.int64), [None] * len(lengths)
        joined = np.flatnonzero(blank)
        for k in range(0, len(joined), 4096):
            part = joined[k:k + 4096]
            ids = np.array(self._ids([b"".join([raw[bounds[i]:bounds[i + 1]] for i in part.tolist()]).decode()])[0], dtype=np.uint32)
            heads = np.flatnonzero(self.leads[ids])
            if len(heads) != len(part):
                blank[part] = False
                continue
            for i, x in zip(part.tolist(), np.split(ids, heads[1:])):
                held[i] = x
        alone = np.flatnonzero(~blank).tolist()
        for i, x in zip(alone, self._ids([raw[bounds[i]:bounds[i + 1]].decode() for i in alone])):
            held[i] = np.array(x, dtype=np.uint32)
        counts[:] = [len(x) for x in held]
        return np.concatenate(held), np.concatenate([[0], np.cumsum(counts)])


@cache
def library_table(path: str) -> IdTable:
    words = LibraryWords(path)
    return IdTable(words.encode, words.specials)


BLOCKS = ("part int, block int, part_start bigint, n_ids bigint, keys array<{key}>, lengths array<bigint>, "
          "words binary, escapes binary")


def write_ids(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append ``END_ID`` and write all ids in ascending key order as Simple-8b blocks."""
    spark = docs.sparkSession
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = plain.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, block, before = library_table(path), TaskContext.get().partitionId(), 0, 0
        for batch in text_chunks(batches, "text"):
            ids, first = known.encode(*bytes_of(batch.column(1)))
            ids = np.insert(ids, first[1:], END_ID)
            first = first + np.arange(len(first))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK_IDS, side="right")) - 1)
                words, escapes = pack(ids[first[at]:first[to]])
                n = int(first[to] - first[at])
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([n], pa.int64()), pa.ListArray.from_arrays([0, to - at], batch.column(0).slice(at, to - at)),
                    pa.array([np.diff(first[at:to + 1]).tolist()], pa.list_(pa.int64())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                ], names=["part", "block", "part_start", "n_ids", "keys", "lengths", "words", "escapes"])
                block, before, at = block + 1, before + n, to

    order = F.xxhash64("text")
    (plain.repartitionByRange(in_shuffle_partitions(spark), "key", order).sortWithinPartitions("key", order)
     .mapInArrow(work, BLOCKS.format(key=kind)).write.parquet(folder))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone."""
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # One row per file, so this window and this broadcast are bounded by the number of files.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, keys, lengths, words, escapes = (batch.column(i)[row] for i in range(6))
                ids = unpack(np.frombuffer(words.as_py(), "<u8"), np.frombuffer(escapes.as_py(), "<u8")).astype("<u4")
                size = lengths.values.to_numpy()
                first = np.concatenate([[0], np.cumsum(size)])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.as_py()] * len(size), pa.int32()), keys.values,
                    pa.array(first[:-1] + start.as_py(), pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()),
                ], names=["part", "key", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "part_start", "keys", "lengths", "words", "escapes").mapInArrow(
        work, f"part int, key {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(parts), "part").select(
        "key", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_ids(spark, folder).withColumnRenamed("key", "doc_id")


QUERIES = {"op10_simple8b_ids": op10_simple8b_ids}
ORACLES: dict[str, str] = {}
