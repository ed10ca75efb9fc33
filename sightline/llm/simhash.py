"""SimHash near-duplicates by pigeonhole blocks (operator 11).

A document's fingerprint has a bit for each bit of XXH64 that is set in more than half of its word shingles. Fingerprints
link at ``RADIUS`` or fewer differing bits. Of ``BLOCKS`` blocks at least ``BLOCKS - RADIUS`` are equal in two linked ones, so
every choice of so many blocks is a key: linked fingerprints meet under one of the keys, and the Hamming distance of
those that meet is verified. Only different fingerprints are joined, copies are counted first.

A key that holds very many fingerprints (families of near copies) is never gathered: the bits that its key leaves free are
cut into blocks in their turn, which spreads it over keys of half as many free bits, until a key can hold 256 fingerprints at
most. Fingerprints that met are reduced in place to one edge each, from a fingerprint to the least one it reaches inside its key,
so nothing of quadratic size is written. No link is lost at any size.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; a text of one or two words is one
shingle; a null key takes part and is a component id only if all its component have null keys; repeated rows
each give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import _WORD, bytes_of, settle, table, text_chunks
from sightline.llm.jaccard import components
from sightline.llm.packed import packed_words, xxh64
from sightline.llm.spread import hot_keys, join_spread

WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
DENSE = 256  # fingerprints compared in one matrix
CHUNK = 2 << 20
SPAN = 1 << 16


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The fingerprint of every text, as unsigned integers."""
    packed = packed_words(*bytes_of(column), _WORD)
    words = np.diff(packed.first)
    per = np.where(words >= WORDS, words - WORDS + 1, (words > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(per)])
    held = np.zeros((len(words), 64), dtype=np.int64)
    for low in range(0, int(ends[-1]), SPAN):
        row = np.arange(low, min(low + SPAN, int(ends[-1])))
        of = np.searchsorted(ends, row, side="right") - 1
        at = packed.first[of] + row - ends[of]
        start, length = packed.spans(at, at + np.minimum(words[of], WORDS) - 1)
        hashes = xxh64(packed.buffer, start, length, SEED)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        held[of[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * held > per[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print) of every row; ``print`` holds the 64 bits as a signed integer."""
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fingerprints_of(batch.column(1)).view(np.int64))], names=["key", "print"])

    return plain.mapInArrow(work, f"key {plain.schema['key'].dataType.simpleString()}, print bigint")


def block_masks(agreed: int = 0) -> list[int]:
    """The masks of the bits that two linked fingerprints may share, beyond those already ``agreed`` on."""
    free = [b for b in range(64) if not agreed >> b & 1]
    blocks = [sum(1 << b for b in free[i * len(free) // BLOCKS:(i + 1) * len(free) // BLOCKS]) for i in range(BLOCKS)]
    return [agreed | sum(chosen) for chosen in combinations(blocks, BLOCKS - RADIUS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def met_links(prints: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links connect among different fingerprints that agree on ``mask``."""
    if len(prints) <= DENSE:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
        label = near.argmax(axis=1)
        while True:
            lower = np.where(near, label[None, :], len(prints)).min(axis=1)
            lower = lower[lower]
            if (lower == label).all():
                break
            label = lower
        other = np.flatnonzero(label != np.arange(len(prints)))
        if len(other):
            yield prints[other], prints[label[other]]
        return
    for finer in block_masks(mask):
        part = prints & np.uint64(finer)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
            if hi - lo > 1:
                yield from met_links(prints[order[lo:hi]], finer)


def _met(keyed: DataFrame, masks: list[int]) -> DataFrame:
    """(a, b) from the fingerprints under one key."""
    groups = keyed.groupBy("m", "part").agg(F.collect_list("print").alias("prints")).filter(F.size("prints") > 1).select("m", "prints")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for m, lo, hi in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                for a, b in met_links(np.sort(flat[lo:hi]), masks[m]):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return groups.mapInArrow(work, "a bigint, b bigint")


def near_links(prints: DataFrame, least: int = DENSE) -> DataFrame:
    """(a, b) edges between different fingerprints ``print`` whose components are those of all links."""
    masks, level, found = [0], prints.select(F.lit(0).alias("m"), "print"), []
    while True:
        step = len(block_masks())
        masks = [finer for m in masks for finer in block_masks(m)]
        listed = F.array(*[F.lit(_signed(m)) for m in masks])
        keyed = level.select("print", F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(step - 1)), lambda j: F.col("m") * step + j)).alias("m")).select(
            "m", F.col("print").bitwiseAND(F.get(listed, F.col("m"))).alias("part"), "print")
        free = 64 - masks[0].bit_count()
        if 1 << free <= DENSE:
            return found_union([*found, _met(keyed, masks)])
        hot = hot_keys(keyed, ["m", "part"], least)
        if hot.isEmpty():
            return found_union([*found, _met(keyed, masks)])
        found.append(_met(keyed.join(F.broadcast(hot), ["m", "part"], "left_anti"), masks))
        level = settle(keyed.join(F.broadcast(hot), ["m", "part"], "left_semi").select("m", "print"), "hot-prints")


def found_union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, print, component_id) of every row."""
    prints = settle(fingerprints(docs, key, text), "prints")
    nodes = settle(prints.groupBy("print").agg(F.min("key").alias("least")), "nodes")
    labels = components(near_links(nodes.select("print")))
    named = settle(nodes.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").select(
        "print", "least", F.coalesce("label", "print").alias("label")), "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = settle(join_spread(named, ids, ["label"]).select("print", "component_id"), "classes")
    return join_spread(prints, of, ["print"]).select(F.col("key").alias(key), "print", "component_id")


def op11_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op11_simhash_blocks": op11_simhash_blocks}
ORACLES: dict[str, str] = {}
