"""Fingerprints against the xxhash library, links against all pairs, whole results against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sightline.llm import simhash
from sightline.llm.packed import packed_words, xxh64
from sightline.llm.simhash import block_masks, fingerprints_of, met_links, near_duplicates, near_links

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(values, radius=2):
    """Least value reachable by links, by comparing all pairs."""
    values = sorted(set(values))
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


TEXTS = [None, "", " \t\n", "one", "One two", "one two three", "one two THREE four", "É ü ß Ünder", "x" * 300 + " y z w",
         "a\x00b c d e", "nb sp a b c", "word " * 500, " ".join(f"w{i}" for i in range(30000)), "q" * 70000 + " b"]


def test_fingerprints():
    got = fingerprints_of(pa.array(TEXTS, pa.string()))
    assert got.tolist() == [fingerprint(t) for t in TEXTS]


def test_hash_of_every_length():
    data = np.frombuffer(bytes(range(1, 256)) * 3, np.uint8)
    buffer = np.concatenate([data, np.zeros(8, np.uint8)])
    length = np.arange(0, 400)
    start = np.arange(400) % 50
    got = xxh64(buffer, start, length, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s:s + n].tobytes(), seed=42) for s, n in zip(start, length)]


def test_packed_words_keep_texts_apart():
    every = np.ones(256, bool)
    every[32] = False
    packed = packed_words(np.frombuffer(b"ABc  d", np.uint8), np.array([0, 2, 2, 6]), every)
    assert packed.buffer.tobytes().rstrip() == b"ab c d" and packed.first.tolist() == [0, 1, 1, 3] and packed.source.tolist() == [0, 2, 5]


def test_masks_cover_every_pair_within_radius():
    rng = np.random.default_rng(1)
    for agreed in (0, block_masks()[3], block_masks(block_masks()[1])[2]):
        free = [b for b in range(64) if not agreed >> b & 1]
        for _ in range(300):
            difference = sum(1 << int(b) for b in rng.choice(free, 2, replace=False))
            assert any(difference & m == 0 for m in block_masks(agreed))


def family(rng, size, bits):
    base = int(rng.integers(0, 1 << 63))
    return sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, bits)), replace=False)) for _ in range(size)})


def connected(values, edges):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_links_of_a_dense_key():
    rng = np.random.default_rng(2)
    values = sorted({int(v) for v in rng.integers(0, 1 << 14, 900)})  # far more than one matrix holds
    edges = [(int(x), int(y)) for a, b in met_links(np.array(values, np.uint64), ((1 << 64) - 1) ^ ((1 << 14) - 1)) for x, y in zip(a, b)]
    assert connected(values, edges) == roots(values)


@pytest.mark.parametrize("least", [4, 256])
def test_near_links(spark, least):
    rng = np.random.default_rng(3)
    values = sorted({*family(rng, 250, 5), *family(rng, 40, 3), *(int(v) for v in rng.integers(0, 1 << 63, 100)), (1 << 64) - 1, 0, 1, 7})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "print bigint").repartition(3)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(df, least).collect()]
    assert connected(values, edges) == roots(values)
    assert len(edges) < 6 * 36 * len(values)


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = roots(prints)
    least = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[label[p]] = min(key, least.get(label[p], key))
    return sorted(((k, p, least.get(label[p])) for (k, _), p in zip(rows, prints)), key=str)


def found(df):
    return sorted(((r[0], r["print"] % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_near_duplicates_of_odd_rows(documents, odd_rows, clashing):
    docs = clashing(documents(odd_rows)).withColumnRenamed("key", "print").repartition(3)
    assert found(near_duplicates(docs)) == expected([r[:2] for r in odd_rows])
    assert near_duplicates(documents([])).count() == 0


def test_query_against_brute_force(spark):
    from tests.conftest import SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    out = simhash.op11_simhash_blocks(spark, SMALL)
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out.collect()), key=str)
    assert all(len(r.fingerprint) == 16 for r in out.collect()) and got == expected(rows)


def test_a_third_of_all_rows_are_copies(documents):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text) for i in range(150)] + [(i, f"{text} extra{i}") for i in range(150, 300)] + [(i, f"other {i} text {i * 7}") for i in range(300, 400)]
    assert found(near_duplicates(documents(rows).repartition(4))) == expected(rows)
