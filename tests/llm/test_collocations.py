"""Phrases against a count of all runs in Python, with and without colliding fingerprints."""

import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm.collocations import collocations, equal_spans, frequent_phrases, scored

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f[lang if lang is not None else "und", tuple(w[i:i + m])] += 1
    return f


def expected(rows, top=2000, least=10):
    f = counts(rows)
    out, kept, over = {}, [], Counter()
    for (lang, v), b in f.items():
        for m in range(2, len(v) if b >= least else 0):
            for i in range(len(v) - m + 1):
                over[lang, v[i:i + m]] = max(over[lang, v[i:i + m]], b)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * over[lang, w] < 50 * a:
            kept.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], score))
    total = Counter()
    for (lang, w), a in f.items():
        total[lang] += a * (len(w) == 1)
    for lang in {r[0] for r in kept}:
        own = sorted((r for r in kept if r[0] == lang), key=lambda r: (-r[5], -r[2], r[1].encode()))
        for i, r in enumerate(own[:top]):
            out[lang, i + 1] = (*r[1:5], total[lang], r[5])
    return out


def got(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(5)
    words = ["a", "Bee", "c\xe9", "d'", "EE", "\U0001f642", "nb\xa0sp", "x\x00y", "long" * 90]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "; "]
    rows = []
    for i in range(120):
        parts = [words[int(rng.integers(0, len(words)))] + marks[int(rng.choice(7, p=[.6, .1, .1, .05, .05, .05, .05]))] for _ in range(60)]
        rows.append((i, "".join(parts), [None, "en", "en", "en", "fr"][i % 5], "s"))
    return rows


@pytest.mark.parametrize("bits", [64, 7])
def test_against_counting(documents, prose, bits):
    rows = [*prose, (900, None, "de", "s"), (901, "", None, "s"), (902, " \n.", "en", "s"), (903, "only words here", "it", "s")]
    want = expected([r[1:3] for r in rows])
    assert len(want) > 200 and {k[0] for k in want} == {"und", "en", "fr"}
    assert got(collocations(documents(rows).repartition(5), bits=bits)) == want


def test_top_and_ties(documents, prose):
    rows = [r[1:3] for r in prose]
    assert got(collocations(documents(prose).repartition(3), top=7)) == expected(rows, top=7)


def test_odd_rows_and_clashing_names(documents, odd_rows, clashing):
    docs = clashing(documents(odd_rows * 10)).withColumnRenamed("row", "phrase").withColumnRenamed("n", "print").repartition(3)
    assert got(collocations(docs)) == expected([r[1:3] for r in odd_rows * 10])
    assert collocations(documents([])).count() == 0


def test_one_very_common_phrase_and_long_text(documents):
    rows = [(i, "the same words again", "en", "s") for i in range(500)] + [(1000, "x y " * 60000, "en", "s")]
    assert got(collocations(documents(rows).repartition(4))) == expected([r[1:3] for r in rows])


def test_exact_counts_of_words(documents, prose):
    found = {(r.lang, r.phrase): r.n for r in frequent_phrases(documents(prose), bits=5).filter("size > 0").collect()}
    assert found == {(lang, " ".join(w)): a for (lang, w), a in counts([r[1:3] for r in prose]).items() if a >= 10}


def test_scores_beyond_64_bits(frame):
    rows = [("en", 1, "x", 7_000_000_000_003), ("en", 1, "y", 6_999_999_999_999), ("en", 2, "x y", 6_999_999_999_998)]
    one = scored(frame(rows, "lang string, size int, phrase string, n bigint")).collect()
    a, left, right = rows[2][3], rows[0][3], rows[1][3]
    assert [(r.phrase, r.a, r.l, r.r, r.score) for r in one] == [("x y", a, left, right, 1000000 * a * a // (left * right))]


def test_equal_spans():
    buffer = np.frombuffer(b"abcdefghij" * 60 + b"abcdefghiX" + b"\0" * 8, np.uint8)
    a, b, n = np.array([0, 0, 0, 1, 0, 5]), np.array([10, 10, 600, 600, 300, 10]), np.array([3, 9, 10, 1, 300, 0])
    assert equal_spans(buffer, a, b, n).tolist() == [True, True, False, False, True, True]
