"""Windows that differ from an item in repeats of one shingle."""

import numpy as np

from sightline.llm import decontaminate


def test_window_sums_number_the_repeats():
    rng = np.random.default_rng(2)
    for n, kinds, span in ((60, 4, 17), (60, 1000, 17), (40, 1, 40), (50, 7, 1)):
        shingles = rng.integers(0, kinds, n).astype(np.uint64)
        want = [decontaminate.signs(decontaminate.numbered(shingles[i:i + span])).sum(axis=0) for i in range(n - span + 1)]
        assert (decontaminate.window_sums(shingles, span) == np.array(want)).all()


def test_repeats_of_one_word_do_not_hide_a_leak(spark, documents):
    items, docs = [], []
    for k in range(40):
        body = [f"k{k}w{j}" for j in range(200)]
        items.append((k, " ".join(body)))
        docs.append((k, " ".join(body[:179] + [f"la{k}"] * 21)))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(documents(docs), frame).collect()}
    assert found == {(k, k) for k in range(40)}
