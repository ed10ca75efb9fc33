"""Toxicity scores from a lexicon trie intersected with Levenshtein automata (operator 8).

The lexicon is learned from labelled documents: whole words, and word beginnings that many different toxic words share,
whose share of toxic documents is several times their share of clean ones. It is held as a trie. For every distinct
word of a text a Levenshtein automaton of the word walks the trie, so misspelled terms are found within one edit (terms of five
and more characters; shorter ones and beginnings under six must be exact). The windows around the hits then tell
quotation from abuse: a hit inside quotation marks, or next to a reporting word, counts as quoted. A logistic regression on
counts of plain and quoted, exact and fuzzy hits gives the score.

Only labelled rows with crc32(key as text) mod 5 other than 0 are learned from, at most ``SAMPLE`` of each label (documented
bounds; the first by a hash of the key), near copies among them once. A score depends on the text alone.

Defined cases: null and empty texts are scored like a text without hits; rows with a null label are not learned from; a null
key is held out; without labels of both kinds the lexicon is empty and every score is 0; repeated rows each give a row; repeated
label rows count once; other columns are ignored by ``scores`` and kept by ``reject``. Whole texts are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import drop_kept, give_back, mix, shingles_of, table, text_chunks, tidy, word_hashes

SAMPLE = 4000
LEAST_RATIO = 8.0
STEM_LENGTHS = range(4, 10)
FUZZY_FROM, FUZZY_STEM_FROM = 5, 6
WINDOW = 80
KNOWN = 200_000
WORD = re.compile(r"[^\W_]+")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
#: Words that report speech.
REPORTS = frozenset("said says quoted quote wrote writes called reported cited told alleged dit écrit sagte schrieb zitiert dijo escribió citó".split())


@dataclass
class Node:
    """A node of the lexicon trie; ``word`` and ``stem`` hold the weight of a term that ends here."""

    children: dict = field(default_factory=dict)
    word: float | None = None
    stem: float | None = None


def build_trie(words: dict[str, float], stems: dict[str, float]) -> Node:
    root = Node()
    for kind, terms in (("word", words), ("stem", stems)):
        for term, weight in terms.items():
            node = root
            for c in term:
                node = node.children.setdefault(c, Node())
            setattr(node, kind, weight)
    return root


def lookup(root: Node, word: str) -> tuple[float, bool] | None:
    """(weight, exact) of the best term that the word is, or begins with, within one edit.

    A state of the automaton is the pair of word positions reachable with no edit and the set reachable with one; it steps
    along the trie, and branches with no reachable position are left.
    """
    best: tuple[float, bool] | None = None
    n = len(word)

    def found(weight: float, exact: bool) -> None:
        nonlocal best
        if best is None or (exact, weight) > (best[1], best[0]):
            best = (weight, exact)

    todo = [(root, 0, {0: 0})]
    while todo:
        node, depth, at = todo.pop()
        if depth:
            if node.word is not None:
                left = at.get(n, 2)
                if depth >= FUZZY_FROM and n - 1 in at:
                    left = min(left, at[n - 1] + 1)
                if left == 0 or (left == 1 and depth >= FUZZY_FROM):
                    found(node.word, left == 0)
            if node.stem is not None and at:
                # A beginning must leave something of the word.
                left = min((e for p, e in at.items() if p < n), default=2)
                if left == 0 or (left == 1 and depth >= FUZZY_STEM_FROM):
                    found(node.stem, left == 0)
        for c, child in node.children.items():
            step: dict[int, int] = {}
            for p, e in at.items():
                if p < n and word[p] == c:
                    step[p + 1] = min(step.get(p + 1, 2), e)
                if e == 0:
                    step[p] = min(step.get(p, 2), 1)  # the term has one character more
                    if p < n:
                        step[p + 1] = min(step.get(p + 1, 2), 1)  # another character
                    if p + 1 < n and word[p + 1] == c:
                        step[p + 2] = min(step.get(p + 2, 2), 1)  # the word has one character more
            if step:
                todo.append((child, depth + 1, step))
    return best


class Lexicon:
    """The trie with a lossless first test: one edit leaves one half of a term as it is."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root = build_trie(words, stems)
        self.heads: dict[int, set[str]] = defaultdict(set)
        self.inner: dict[int, set[str]] = defaultdict(set)
        self.places: dict[int, set[int]] = defaultdict(set)
        self.tails: dict[int, set[str]] = defaultdict(set)
        for terms, fuzzy in ((words, FUZZY_FROM), (stems, FUZZY_STEM_FROM)):
            for t in terms:
                if len(t) < fuzzy:
                    self.heads[len(t)].add(t)
                    continue
                half = len(t) // 2
                self.heads[half].add(t[:half])
                if terms is words:
                    self.tails[len(t) - half].add(t[half:])
                else:
                    self.inner[len(t) - half].add(t[half:])
                    self.places[len(t) - half] |= {half - 1, half, half + 1}
        self.known: set[str] = set()
        self.found: dict[str, tuple[float, bool]] = {}

    def possible(self, word: str) -> bool:
        for k, held in self.heads.items():
            if word[:k] in held:
                return True
        for k, held in self.tails.items():
            if word[-k:] in held:
                return True
        for k, held in self.inner.items():
            for p in self.places[k]:
                if word[p:p + k] in held:
                    return True
        return False

    def hits(self, words: set[str]) -> dict[str, tuple[float, bool]]:
        """The words that match a term."""
        new = words.difference(self.known)
        if new:
            if len(self.known) > KNOWN:
                self.known, self.found = set(), {}
                new = words
            for w in new:
                if self.possible(w) and (hit := lookup(self.root, w)) is not None:
                    self.found[w] = hit
            self.known |= new
        return {w: self.found[w] for w in words.intersection(self.found)}


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in quotation marks or next to a reporting word, in the window around it."""
    before, after = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    before, after = before[before.rfind("\n") + 1:], after.split("\n", 1)[0]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    near = WORD.findall(before)[-3:] + WORD.findall(after)[:2]
    return any(w in REPORTS for w in near)


FEATURES = 7


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """Counts and weights of plain and quoted, exact and fuzzy hits of a whole text."""
    out = np.zeros(FEATURES)
    low = text.lower()
    hits = lexicon.hits(set(WORD.findall(low)))
    if not hits:
        return out
    kinds = Counter()
    weight, words, distinct = 0.0, 0, set()
    for m in WORD.finditer(low):
        words += 1
        hit = hits.get(m[0])
        if hit:
            quoted = is_quoted(low, *m.span())
            kinds[(hit[1], quoted)] += 1
            if hit[1] and not quoted:
                weight += hit[0]
                distinct.add(m[0])
    out[:4] = [math.log1p(kinds[k]) for k in ((True, False), (True, True), (False, False), (False, True))]
    out[4] = math.log1p(weight)
    out[5] = math.log1p(len(distinct))
    out[6] = math.log1p(1000 * kinds[(True, False)] / max(words, 1))
    return out


def _apart(texts: list[str]) -> list[int]:
    """The first text of each group of near copies, by three minimum shingle hashes."""
    kept, seen = [], set()
    shingles, ends = shingles_of(*word_hashes(pa.array(texts, pa.string())))
    for i in range(len(texts)):
        own = shingles[ends[i]:ends[i + 1]]
        if not len(own):
            continue
        keys = {(s, int(mix(own ^ np.uint64(s)).min())) for s in (11, 23, 47)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """(words, beginnings) with their log odds of being in a toxic text."""
    toxic, clean = ([texts[i] for i in _apart(texts)] for texts in (toxic, clean))
    if not toxic or not clean:
        return {}, {}
    n1, n0 = len(toxic), len(clean)
    counts = (Counter(), Counter())
    stems = (Counter(), Counter())
    endings = defaultdict(set)
    for label, texts in enumerate((clean, toxic)):
        for text in texts:
            held = {w for w in WORD.findall(text.lower()) if not any(c.isdigit() for c in w)}
            counts[label].update(held)
            own = {w[:k] for w in held for k in STEM_LENGTHS if len(w) > k}
            stems[label].update(own)
            if label:
                for w in held:
                    for k in STEM_LENGTHS:
                        if len(w) > k:
                            endings[w[:k]].add(w[k:])

    def odds(c1: int, c0: int) -> float:
        return math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))

    enough = math.log(LEAST_RATIO)
    least = max(4, 0.02 * n1)
    gain = {s: c / n1 - stems[0][s] / n0 for s, c in stems[1].items()
            if c >= least and odds(c, stems[0][s]) >= enough and len(endings[s]) >= 5}
    chosen: dict[str, float] = {}
    for s in sorted(gain, key=lambda s: (-gain[s], len(s), s)):
        if not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen[s] = odds(stems[1][s], stems[0][s])
    words = {w: odds(c, counts[0][w]) for w, c in counts[1].items()
             if c >= max(4, 0.01 * n1) and len(w) >= 3 and odds(c, counts[0][w]) >= enough + 0.7
             and not any(w.startswith(s) and len(w) > len(s) for s in chosen)}
    return words, chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients, the last one constant, by Newton steps on the ridge-penalised likelihood, both labels weighing the same."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    b = np.zeros(x.shape[1])
    penalty = np.diag([ridge * len(x) / 100] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    coefficients: list[float] | None

    def scorer(self):
        lexicon = Lexicon(self.words, self.stems)
        if self.coefficients is None:
            return lambda text: 0.0
        b = np.array(self.coefficients)

        def score(text: str) -> float:
            z = float(features(text, lexicon) @ b[:-1] + b[-1])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def train(toxic: list[str], clean: list[str]) -> Model:
    words, stems = learn_lexicon(toxic, clean)
    if not words and not stems:
        return Model({}, {}, None)
    lexicon = Lexicon(words, stems)
    x = np.array([features(t, lexicon) for t in [*toxic, *clean]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    return Model(words, stems, fit_logistic(x, y).tolist())


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE`` labelled rows of each label that are not held out."""
    marks = labels.select(labels[key].alias("key"), labels[label].alias("y")).filter(
        F.col("key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("key"))).distinct()
    order = F.xxhash64("key", F.lit(5))
    picked = [marks.filter(F.col("y") == y).orderBy(order, "key").limit(SAMPLE) for y in (1, 0)]
    wanted = picked[0].union(picked[1])
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).filter(F.col("text").isNotNull())
    # ``wanted`` has at most 2 * SAMPLE rows, so it may be broadcast.
    rows = texts.join(F.broadcast(wanted), "key").select("text", "y").toArrow().to_pydict()
    held = list(zip(rows["y"], rows["text"]))
    model = train(sorted(t for y, t in held if y == 1), sorted(t for y, t in held if y == 0))
    del rows, held
    give_back()  # the driver's process goes on for the rest of the job
    return model


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"), held_out(docs[key]).alias("held_out"))
    kind = plain.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        score = sent.value.scorer()
        for batch in text_chunks(batches, "text"):
            s = [score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())],
                names=["key", "held_out", "score", "predicted"])

    return plain.mapInArrow(tidy(work), f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        score = sent.value.scorer()
        for batch in text_chunks(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            yield batch.filter(pa.array([score(t or "") < threshold for t in column.to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(work), docs.schema)


def op8_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_levenshtein_toxicity": op8_levenshtein_toxicity}
ORACLES: dict[str, str] = {}
