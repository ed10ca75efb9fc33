"""Byte-pair encoding and decoding by an index of pair occurrences (operator 5).

All distinct pre-tokens that a partition has not met before are laid out as one sequence of symbols. An index
maps every mergeable pair, by its rank, to all its positions in that sequence. Active ranks are applied in ascending
order, each at all its positions at once; the pairs that a merge creates are filed under their own ranks.

Defined cases: a null text counts as empty; an empty text has no ids; the special tokens of the vocabulary are one id
each wherever their string stands in a text. Repeated rows and repeated doc_ids each give a row; a null doc_id stays null.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import bytes_of, give_back, kept_table, table, text_chunks, tidy
from sightline.llm.tokens import IdTable

CHUNK = 1 << 20  # of text; arrays over its pre-tokens and ids take about 30 times as much


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return letters


class PairIndex:
    """A byte-level BPE vocabulary with its merges, applied rank by rank to many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.equal = left == right
        self.size = 1 + max(*vocab.values(), *(t["id"] for t in spec["added_tokens"]))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank = np.append(keys[order], np.iinfo(np.int64).max), order
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.known = IdTable(self.merge, self.specials)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.rank[np.where(found, at, 0)], -1)

    def merge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, first id of each with a closing end), from their bytes and offsets."""
        n = len(data)
        starts, ends = offsets[:-1], offsets[1:]
        sym = self.byte_id[data]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1], prv[starts] = -1, -1
        pair = np.full(n, -1, dtype=np.int32)
        inner = np.flatnonzero(nxt >= 0).astype(np.int32)
        pair[inner] = self._ranks(sym[inner], sym[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            ranks = pair[at]
            held = ranks >= 0
            at, ranks = at[held], ranks[held]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, i, j in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        file(inner)
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[pair[at] == rank]
            if not len(at):
                continue
            at.sort()
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if self.equal[rank]:
                at = self._apart(at, nxt)
            gone = nxt[at]
            after = nxt[gone]
            sym[at], nxt[at] = self.made[rank], after
            sym[gone], pair[gone], pair[at] = -1, -1, -1
            tail = after >= 0
            prv[after[tail]] = at[tail]
            before = prv[at]
            touched = np.concatenate([before[before >= 0], at[tail]])
            pair[touched] = self._ranks(sym[touched], sym[nxt[touched]])
            file(touched)
        kept = sym >= 0
        return sym[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]

    @staticmethod
    def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of overlapping pairs of one symbol with itself, every other one from the left."""
        chained = np.zeros(len(at), dtype=bool)
        chained[1:] = nxt[at[:-1]] == at[1:]
        place = np.arange(len(at))
        run = np.maximum.accumulate(np.where(chained, 0, place))
        return at[(place - run) % 2 == 0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text with a closing end)."""
        return self.known.encode(*bytes_of(column))

    def decode(self, ids: np.ndarray) -> str:
        held = self.token_bytes
        return b"".join([held[i] for i in ids.tolist()]).decode("utf-8", errors="replace")


def pair_index(path: str) -> PairIndex:
    def make() -> PairIndex:
        index = PairIndex(path)
        give_back()
        return index

    return kept_table(("pair index", path), make)


def _apply(docs: DataFrame, key: str, text: str, path: str, columns: str, make) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pair_index(path)
        for batch in text_chunks(batches, "text", CHUNK):
            ids, first = index.encode(batch.column(1))
            parts = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
            held = make(index, parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *held.values()], names=["key", *held])

    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return plain.mapInArrow(tidy(work), f"key {kind}, {columns}").withColumnRenamed("key", key)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids as little-endian unsigned 32-bit integers, decoded string) of every row; one pass without a shuffle."""
    return _apply(docs, key, text, path, "ids binary, decoded string", lambda index, parts: {
        "ids": pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()),
        "decoded": pa.array([index.decode(x) for x in parts], pa.string()),
    })


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and SHA-256 of the ids and of the decoded text, per row, so that neither leaves the worker."""
    sha = hashlib.sha256
    return _apply(docs, key, text, path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda index, parts: {
        "n_tokens": pa.array([len(x) for x in parts], pa.int64()),
        "ids_sha256": pa.array([sha(x.astype("<u4").tobytes()).hexdigest() for x in parts], pa.string()),
        "decoded_sha256": pa.array([sha(index.decode(x).encode()).hexdigest() for x in parts], pa.string()),
    })


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``digests`` with the ids themselves, as little-endian unsigned 32-bit integers."""
    sha = hashlib.sha256
    columns = "n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string"
    return _apply(docs, key, text, path, columns, lambda index, parts: {
        "n_tokens": pa.array([len(x) for x in parts], pa.int64()),
        "ids": pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()),
        "ids_sha256": pa.array([sha(x.astype("<u4").tobytes()).hexdigest() for x in parts], pa.string()),
        "decoded_sha256": pa.array([sha(index.decode(x).encode()).hexdigest() for x in parts], pa.string()),
    })


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_bpe_roundtrip": op5_bpe_roundtrip}
ORACLES: dict[str, str] = {}
