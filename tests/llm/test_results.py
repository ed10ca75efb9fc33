"""Results of the corpus operators against brute force, exact round trips or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import bpe, decontaminate, jaccard, licences, maintext, pivots, secrets, sharding, simple8b, toxicity
from sightline.llm.common import shared_path

SMALL = "/root/testdata/sf0.001"
TOKENS = bpe.tokenizer_path()
LIBRARY = Tokenizer.from_file(TOKENS)
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'", "<|endoftext|>", "é", "\x1c", "\x85", "\xa0", "中", "🙂", "1", "²", "!", "…",
          "aaaa", "　", "​", "don't", " the", "###", "×", "s", "re"]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingles(text):
    w = words(text)
    return [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


@pytest.fixture(scope="module")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_bpe_ids_and_round_trip(texts):
    index = bpe.pair_index(TOKENS)
    ids, first = index.encode(pa.array(texts))
    for text, a, b in zip(texts, first[:-1], first[1:]):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert index.decode(ids[a:b]) == LIBRARY.decode(want, skip_special_tokens=False)


@given(st.lists(st.one_of(st.just(0), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=400))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    assert (simple8b.unpack(*simple8b.pack(values)) == values).all()


def test_simple8b_zero_runs_take_one_word():
    words_, _ = simple8b.pack(np.zeros(240, np.uint64))
    assert len(words_) == 2


def test_token_files_hold_the_library_ids(spark, small_docs):
    folder = shared_path(spark, "ids")
    simple8b.write_ids(small_docs, TOKENS, folder)
    got = {r.key: (r.start, r.n_tokens, r.ids_crc32) for r in simple8b.read_ids(spark, folder).collect()}
    at = 0
    for row in small_docs.orderBy("doc_id").collect():
        ids = [*LIBRARY.encode(row.text, add_special_tokens=False).ids, 2]
        assert got[row.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def near_texts(seed=3):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(6, 160)))]
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 40)))):
                copy[int(rng.integers(len(copy)))] = f"x{rng.integers(1000)}"
            cut = int(rng.integers(0, max(1, len(copy) // 6)))
            texts.append(" ".join(copy[cut:]) + (" " + passage if g % 3 == 0 else ""))
    return [*texts, *texts[:5], "a b c", "A b\tc", "", None]


def brute_components(rows):
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components(documents, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    rows = list(enumerate(near_texts(seed)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(documents(rows)).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in jaccard.keep_one(documents(rows)).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_signature(common, more, other, seed):
    rng = np.random.default_rng(seed)
    h = np.unique(rng.integers(0, 2**63, common + more + other).astype(np.uint64))
    rng.shuffle(h)
    a, b = np.sort(h[:common + more]), np.sort(np.concatenate([h[:common], h[common + more:]]))
    if 100 * common < 80 * len(h):
        return
    found, of = jaccard.signatures([a, b])
    assert set(found[of == 0].tolist()) & set(found[of == 1].tolist())


def test_bitmap_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(100):
        h = rng.integers(0, 2**63, 600).astype(np.uint64)
        a, b = np.unique(h[:rng.integers(1, 500)]), np.unique(h[rng.integers(0, 300):])
        x, y = jaccard.folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        bound = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
        assert bound >= len(np.intersect1d(a, b))


def test_pivot_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 20)
    monkeypatch.setattr(pivots, "QUERY_ROWS", 4)
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.normal(size=(150, 6)), np.tile(rng.normal(size=(1, 6)), (60, 1)), np.zeros((3, 6))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = np.floor(256 * m).astype(np.int64)
    want = []
    for i in range(0, len(m), 10):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(len(m)) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    got = [tuple(r) for r in pivots.search(vectors, vectors.filter(F.col("vec_id") % 10 == 0)).collect()]
    assert sorted(got) == sorted(want)


SECRET = (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
          re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def test_secret_spans(documents):
    rng = np.random.default_rng(2)
    parts = ["password=", "Token: '", "api_key = ", "APIKEY:", "secret", "AKIA", "ABCDEF12", "0123456789abcdef", "deadbeef", " ", "é🙂", "\n",
             "xyzw/+_.", "token=token:", '"', "hello"]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 30))))) for i in range(250)] + [(900, "token=abcdefghijk1 " * 300)]
    got = {r.doc_id: r for r in secrets.scan(documents(rows)).collect()}
    for i, text in rows:
        spans = sorted((m.start(), k, m.end()) for k, (p, least) in enumerate(zip(SECRET, (12, 18, 16))) for m in p.finditer(text)
                       if len(m[2] if k == 0 else m[0]) >= least)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] not in ("live", "example")] == [s for s in joined.split(",") if s]


def test_widely_copied_secrets_are_examples(documents):
    rows = [(i, f"x token=EXAMPLEEXAMPLE{'' if i % 2 else ' y'}", "en", f"s{i}") for i in range(4)] + [(9, "é token=r4nd0mv4lu3xyz end", "en", "s1")]
    docs = documents(rows)
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert got[0] == "assign:2:22,example:8:22"
    assert got[9] == "assign:2:22,live:8:22"
    masked = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs, length="n_chars").collect()}
    assert masked[9] == ("é token=[SECRET] end", 20)
    assert masked[1][0] == "x token=[EXAMPLE]"


def test_shards(documents):
    rng = np.random.default_rng(0)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(3000)] + [(i, "hot" * 30) for i in range(3000, 3600)]
    got = sharding.assign(documents(rows)).toPandas()
    text = dict(rows)
    assert (got["size"] == [len(text[i]) + 1 for i in got.doc_id]).all()
    assert (got.text_crc32 == [zlib.crc32(text[i].encode()) for i in got.doc_id]).all()
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(8)) and load.max() - load.min() < 0.01 * load.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id >= 3000].shard.nunique() == 1


def test_text_larger_than_a_shard_is_split(documents):
    got = sharding.assign(documents([(i, "same text") for i in range(4000)])).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() < 1.1 * load.mean()


def test_written_shards_hold_all_rows(spark, small_docs):
    folder = shared_path(spark, "shards")
    sharding.write_shards(small_docs, folder)
    back = spark.read.parquet(folder)
    assert back.select(small_docs.columns).exceptAll(small_docs).count() == 0 and back.count() == small_docs.count()


def brute_leaks(docs, items):
    found = {}
    for i, text in docs:
        w, s = words(text), shingles(text)
        for k, item in items:
            size = len(words(item))
            own = Counter(shingles(item))
            if not size or len(w) < min(size, 5):
                continue
            width = min(size, 5)
            s = [tuple(w[j:j + width]) for j in range(len(w) - width + 1)]
            span = min(size, len(w)) - width + 1
            best = 0
            for a in range(len(s) - span + 1):
                c = Counter(s[a:a + span])
                both = sum((c & own).values())
                best = max(best, both / (sum(c.values()) + sum(own.values()) - both))
            if best >= 0.8:
                found[(i, k)] = best
    return found


def test_leaks_equal_brute_force(spark, documents):
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(size))) for k, size in enumerate((3, 5, 9, 14, 30, 60))] + [(9, "the the the the the the the the")]
    docs = []
    for i in range(60):
        k = int(rng.integers(len(items)))
        w = items[k][1].split()
        if i % 3 == 0 and len(w) > 20:
            w[int(rng.integers(len(w)))] = "changed"
        noise = [f"n{x}" for x in rng.integers(0, 50, int(rng.integers(0, 80)))]
        docs.append((i, " ".join(noise[:40] + w[i % 2:] + noise[40:]).title()))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.matches(documents(docs), frame).collect()}
    want = brute_leaks(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    kept = {r.doc_id for r in decontaminate.clean(documents(docs), frame).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1)
    return row[-1]


@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abc", min_size=3, max_size=8), min_size=1, max_size=6),
       st.lists(st.text("abc", min_size=4, max_size=8), max_size=3))
@settings(max_examples=400, deadline=None)
def test_automaton_over_trie_equals_edit_distance(word, terms, stems):
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms}, {s: 1.0 for s in stems})
    got = lexicon.hits({word}).get(word)
    exact = word in terms or any(word.startswith(s) and len(word) > len(s) for s in stems)
    fuzzy = any(len(t) >= 5 and distance(word, t) <= 1 for t in terms) or any(
        len(s) >= 6 and any(distance(word[:p], s) <= 1 for p in range(len(word))) for s in stems)
    assert (got is not None) == (exact or fuzzy)
    assert not got or got[1] == exact


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]


def test_quotation_is_told_from_abuse():
    assert toxicity.is_quoted('she said "you clown" and left', 15, 20)
    assert not toxicity.is_quoted("you clown and more", 4, 9)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><h1>Site name here</h1></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><div class="cookie-notice">We use cookies on this site</div>
<ARTICLE><h1>Head &amp; line</h1><p>First   paragraph of<br>the text, with <b>bold</b> words.<p>Second &lt;one&gt; with a &nbsp; space and some more words
<aside>Side note that is not part of it</aside><form><input name=q><button>Go</button></form><p>Third paragraph closes the article.
<div id="comments"><p>First! great post</p></div></ARTICLE><script>var x = "<p>no</p>";</script><footer>&copy; nobody</footer></body></html>"""
TEXT = "Head & line\nFirst paragraph of the text, with bold words.\nSecond <one> with a space and some more words\nThird paragraph closes the article."


def test_main_text(spark):
    learned = maintext.learn([r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()])
    assert maintext.main_text(PAGE, *learned) == TEXT
    assert maintext.main_text(PAGE.replace("ARTICLE", "div"), *learned) == TEXT
    assert maintext.main_text(PAGE.replace("<body>", "<body><div class='row has-sidebar'>"), *learned) == TEXT
    assert maintext.main_text("<div class='widget'><p>Only text of the page</p></div>", *learned) == "Only text of the page"


def test_names_drop_only_containers_of_other_things(spark):
    learned = maintext.learn([r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()])
    page = """<html><body><div class="promo"><p>Subscribe to our other things today</p></div><article>
<h2 id="related-work">Related work</h2><p>The first paragraph says <math><mi>x</mi></math> is a number that we all know quite well.</p>
<section class="section-header"><p>A titled section has its own words that belong to the text.</p></section>
<div class="share-price"><p>The share price rose by a tenth over the year in the table.</p></div>
<section id="cookies"><p>How cookies are stored is what this part explains to readers.</p></section>
<pre><code>a = 1 <span class="hljs-comment"># keep this comment</span></code></pre>
<div class="social-history"><p>The social history of the town is told in the last part.</p></div>
<div class="share-buttons"><p>Tell your friends</p></div><div class="ad-slot"><p>Buy now</p></div>
<div class="comments-list"><p>First! great post</p></div></article></body></html>"""
    got = maintext.main_text(page, *learned)
    for kept in ("Related work", "says x is a", "titled section", "share price rose", "cookies are stored", "# keep this comment", "social history of"):
        assert kept in got
    for left_out in ("Tell your friends", "Buy now", "First!", "Subscribe"):
        assert left_out not in got


def test_region_is_the_best_contiguous_one():
    rng = np.random.default_rng(4)
    weights = maintext.Weights({(False, "p", False): 0.5, (False, "li", True): -0.5}, -0.3)
    for _ in range(200):
        tokens = [maintext.Run("w", int(n), (False, "p", False) if n % 2 else (False, "li", True)) if n else maintext.Run()
                  for n in rng.integers(0, 6, 12)]
        score = [t.words * weights.word(t.context) if t.words else weights.tag for t in tokens]
        a, b = maintext.best_region(tokens, weights)
        best = max([0, *(sum(score[i:j]) for i in range(12) for j in range(i + 1, 13))])
        assert abs(sum(score[a:b]) - best) < 1e-9


def test_licences_inherit_from_the_nearest_directory(spark):
    body = "plain words of no licence at all " * 10
    rows = [(1, "/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "/a/b/LICENSE", "Released under the MIT License."),
            (3, "/a/x.txt", body), (4, "/a/b/c/y.txt", body), (5, "/z/q.txt", body), (6, "/a/b/own.txt", body + "\nLicensed under CC BY-NC 4.0.\n" + body),
            (7, "/ab/w.txt", body), (8, "/a/b/german.txt", "Mit und.\n" + body)]
    got = {r.doc_id: (r.license, r.basis, r.inherited_from) for r in
           licences.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "file", None), 2: ("MIT", "file", None), 3: ("Apache-2.0", "inherited", 1), 4: ("MIT", "inherited", 2),
                   5: (None, "none", None), 6: ("CC-BY-NC-4.0", "own", None), 7: (None, "none", None), 8: ("MIT", "inherited", 2)}


def test_full_licence_texts_are_files(spark):
    from sightline.llm.licence_texts import TEXTS

    full = {}
    for name, text in TEXTS:
        full.setdefault(name, text)
    headers = dict(TEXTS[-7:])
    body = "\n".join(f"value{i} = compute{i}(first{i}, second{i})" for i in range(200))
    rows = [(i, f"/{name}/LICENSE", "Copyright (c) 2019 Some Body\nAll rights reserved.\n\n" + text) for i, (name, text) in enumerate(full.items())]
    rows += [(100 + i, f"/{name}/src/code.py", body) for i, name in enumerate(full)]
    rows += [(200 + i, f"/headers/{name}.c", text + "\n" + body) for i, (name, text) in enumerate(headers.items())]
    rows += [(300, "/opening/COPYING", "\n".join(full["GPL-3.0"].split("\n")[:20]))]
    got = {r.doc_id: (r.license, r.basis, r.inherited_from) for r in
           licences.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    for i, name in enumerate(full):
        assert got[i] == (name, "file", None) and got[100 + i] == (name, "inherited", i)
    assert [got[200 + i][0] for i in range(len(headers))] == list(headers)
    assert got[300][0] == "GPL-3.0"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SMALL)
        if n < 4:
            assert after.columns == docs.columns
            folder = shared_path(spark, "stage")
            after.write.parquet(folder)
            after = spark.read.parquet(folder)
        before, kept = ({r.doc_id: r for r in x.collect()} for x in (docs, after))
        texts = [(i, r.text) for i, r in before.items()]
        if n == 1:
            assert set(kept) == {i for i, (_, c) in brute_components(texts).items() if i == c}
        if n == 2:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert set(kept) == set(before) - {i for i, _ in brute_leaks(texts, items)}
        if n in (3, 4):
            assert set(kept) == set(before)
        if n == 4:
            assert all(r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() for i, r in kept.items())
        docs = after
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert run == {i: r.ids_sha256 for i, r in kept.items()}


def test_linked_sets_share_the_cells_they_need():
    rng = np.random.default_rng(7)
    for size in (1, 2, 5, 9, 10, 31, 64, 65, 200, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(1, 1 << 63, size).astype(np.uint64))
            gone = int(rng.integers(0, len(a) // 5 + 1))
            b = a[gone:]
            more = rng.integers(1, 1 << 63, int(rng.integers(0, max(1, len(a) // 4)))).astype(np.uint64)
            b = np.unique(np.concatenate([b, more]))
            overlap = len(np.intersect1d(a, b))
            if not jaccard.linked(overlap, len(a), len(b)):
                continue
            found, of = jaccard.signatures([a, b])
            shared = len(np.intersect1d(found[of == 0], found[of == 1]))
            assert shared >= jaccard.least_shared([a, b]).max() >= 1


def test_needs_of_empty_sets():
    none = np.zeros(0, np.uint64)
    assert jaccard.least_shared([none, np.array([5], np.uint64), none]).tolist() == [0, 1, 0]
    assert jaccard.least_shared([]).tolist() == []
