"""The index of benchmark items: all pairs that share a near block, in little memory."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import common, decontaminate


def texts(n, sizes):
    return tuple(" ".join(f"w{i}x{j}" for j in range(sizes[i % len(sizes)])) for i in range(n))


@pytest.mark.parametrize("step", [1 << 18, 100])
def test_candidates_are_the_near_items(monkeypatch, step):
    monkeypatch.setattr(decontaminate, "PROBED", step, raising=False)
    index, _ = decontaminate._build(texts(60, (12, 30, 31)))
    rng = np.random.default_rng(3)
    flips = np.packbits(rng.random((240, 128)) < 0.2, axis=1).view(np.uint16)
    windows = np.concatenate([np.tile(index.prints, (4, 1)) ^ flips, index.prints, np.array([[0] * 8, [65535] * 8], np.uint16)])
    for rank, size in enumerate(index.lengths.tolist()):
        own = np.flatnonzero(index.sizes == size)
        differ = np.bitwise_count(windows[:, None] ^ index.prints[own])
        near = (differ.sum(axis=2) <= decontaminate.RADIUS) & (differ.min(axis=2) <= decontaminate.RADIUS // decontaminate.BLOCKS)
        w, i = np.nonzero(near)
        got = index.candidates(windows, rank)
        assert got[0].tolist() == w.tolist() and got[1].tolist() == own[i].tolist() and len(w) > 20


def test_an_item_takes_little_memory():
    tracemalloc.start()
    index, _ = decontaminate._build(texts(200, range(15, 58)))
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(index.lengths) == 43 and held < 25e6 and peak < 40e6


def test_memory_is_given_back_after_the_last_batch_is_gone(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append([r() for r in held]))

    class Batch:
        pass

    held = []

    def source():
        for _ in range(2):
            batch = Batch()
            held.append(weakref.ref(batch))
            yield batch
            del batch

    def work(batches):
        for _batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])

    assert len(list(common.tidy(work)(source()))) == 2
    assert seen == [[None, None]]
