"""Phrase collocations from Rabin-Karp fingerprints (operator 12).

Texts are cut into pieces at punctuation and line ends, pieces into words. A numpy prefix polynomial over the word hashes of
a batch gives the fingerprint of every run of one, two or three words from two places of it, so no phrase is built to be
counted. Tasks send (fingerprint, count, text hash) rows; a shuffle adds them up and keeps the least hash as a pointer to a text
with an occurrence. Longer phrases are only fingerprinted where both their shorter parts are frequent; a bitmap of the
frequent ones decides that in the tasks. It has at most ``MAP_BITS`` bits: beyond some ten million frequent phrases it lets
more and more others pass, which costs shuffle but changes no result.

A last scan materialises frequent phrases only, and verifies fingerprints against the text: in a batch all occurrences of a
fingerprint are compared, byte by byte, with the one its pointer names, and those that differ are counted apart; batches are then
added up by phrase, not by fingerprint. So counts are exact whatever collides; ``bits`` shortens fingerprints, to show it.

Defined cases: a null language is ``und``; a null, empty or wordless text adds nothing; a language without candidates has no row;
repeated rows count each; other columns are ignored. Counts are 64-bit, scores are worked out in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import bytes_of, mix, settle, table, text_chunks
from sightline.llm.packed import Packed, packed_words, xxh64
from sightline.llm.spread import join_spread

LONGEST = 3
LEAST = 10
COVERED = 50  # per cent of a phrase's occurrences that lie inside one longer phrase
TOP = 2000
UNKNOWN = "und"
MAP_BITS = 1 << 27
SALTS = 16
LEVELS = 32  # of score, an octave
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


class Words:
    """The words of a batch of texts with the fingerprints of their runs."""

    def __init__(self, texts: pa.Array, langs: pa.Array, bits: int = 64):
        data, offsets = bytes_of(texts)
        self.packed: Packed = packed_words(data, offsets, _INSIDE)
        named = pc.fill_null(langs, UNKNOWN).dictionary_encode()
        self.langs = named.dictionary
        of = np.repeat(np.arange(len(texts)), np.diff(self.packed.first))
        self.lang = named.indices.to_numpy().astype(np.int64)[of]
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[data]), self.packed.source) + of
        self.row = of
        n = len(of)
        hashes = xxh64(self.packed.buffer, self.packed.start, self.packed.length, 0)
        powers = np.ones(n + 1, dtype=np.uint64)
        powers[1:] = BASE
        np.cumprod(powers, out=powers)
        self.back = np.ones(n + 1, dtype=np.uint64)
        self.back[1:] = INVERSE
        np.cumprod(self.back, out=self.back)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * powers[:n], out=self.prefix[1:])
        salts = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()] or [0], dtype=np.uint64)
        self.salt = salts[self.lang]
        self.keep = np.uint64((1 << bits) - 1)

    def runs(self, size: int) -> np.ndarray:
        """First words of the runs of ``size`` words that lie in one piece."""
        n = len(self.piece)
        if n < size:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.piece[:n - size + 1] == self.piece[size - 1:])

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the runs: the polynomial of their words, moved to power zero, for one language and size."""
        polynomial = (self.prefix[at + size] - self.prefix[at]) * self.back[at]
        return mix(polynomial + self.salt[at] * np.uint64(2 * size + 1) + np.uint64(size)) & self.keep

    def frequent_runs(self, size: int, maps: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of the runs whose two parts of ``size`` - 1 words are marked as frequent."""
        at = self.runs(size)
        if size > 1:
            at = at[marked(maps[size - 1], self.prints(at, size - 1))]
            at = at[marked(maps[size - 1], self.prints(at + 1, size - 1))]
        return at, self.prints(at, size)


def marked(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = (prints & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(prints: DataFrame) -> np.ndarray:
    """A bitmap of the column ``print``: 16 bits for each row, ``MAP_BITS`` at most."""
    size = min(MAP_BITS, max(1 << 16, 1 << (16 * prints.count()).bit_length()))
    place = F.col("print").bitwiseAND(F.lit(size - 1)) + 1
    rows = prints.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).toLocalIterator()
    held = np.zeros(size // 8, dtype=np.uint8)
    for row in rows:
        at = (row["b"] - 1) * 4096
        held[at:at + 4096] = np.frombuffer(row["m"], np.uint8)
    return held


def equal_spans(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` and at ``b`` are the same; the buffer ends with eight spare bytes."""
    lanes = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    for i in np.flatnonzero(length > 256).tolist():
        same[i] = np.array_equal(buffer[a[i]:a[i] + length[i]], buffer[b[i]:b[i] + length[i]])
    live, done = np.flatnonzero(length <= 256), 0
    while len(live):
        unread = np.maximum(8 - (length[live] - done), 0).astype(np.uint64) * np.uint64(8)
        differ = (lanes[a[live] + done] ^ lanes[b[live] + done]) << unread
        same[live[differ != 0]] = False
        done += 8
        live = live[(differ == 0) & (length[live] > done)]
    return same


def _strings(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=ends[1:])
    flat = buffer[np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(flat)).cast(pa.string())


def verified(words: Words, at: np.ndarray, prints: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pointers, counts): occurrences of one fingerprint are compared with the first of them, others are counted apart."""
    start, length = words.packed.spans(at, at + size - 1)
    order = np.argsort(prints, kind="stable")
    while len(order):
        head = np.concatenate([[True], prints[order[1:]] != prints[order[:-1]]])
        group = np.cumsum(head) - 1
        pointer = order[head][group]
        same = (length[order] == length[pointer]) & (words.lang[at[order]] == words.lang[at[pointer]])
        same[same] = equal_spans(words.packed.buffer, start[order[same]], start[pointer[same]], length[order[same]])
        yield at[order[head]], np.bincount(group[same], minlength=group[-1] + 1)
        order = order[~same]


def _plain(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"),
                       F.xxhash64(docs[text], docs[lang]).alias("row"))


def _counted(plain: DataFrame, size: int, maps: dict[int, np.ndarray], bits: int) -> DataFrame:
    """(print, n, row): fingerprints of runs that may be frequent, their counts, and a pointer to a text with an occurrence."""
    shared = plain.sparkSession.sparkContext.broadcast(maps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text", CHUNK):
            words = Words(batch.column(0), batch.column(1), bits)
            at, prints = words.frequent_runs(size, shared.value)
            found, first, count = np.unique(prints, return_index=True, return_counts=True)
            rows = batch.column(2).to_numpy()[words.row[at[first]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(count), pa.array(rows)], names=["print", "n", "row"])

    found = plain.mapInArrow(work, "print bigint, n bigint, row bigint")
    return found.groupBy("print").agg(F.sum("n").alias("n"), F.min("row").alias("row"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bits: int = 64) -> DataFrame:
    """(lang, size, phrase, n): exact counts of all phrases of 1 to ``LONGEST`` words with ``least`` occurrences or more.

    Rows of size 0 hold the number of words of a language.
    """
    plain, maps = _plain(docs, text, lang), {}
    for size in range(1, LONGEST + 1):
        many = settle(_counted(plain, size, maps, bits).filter(F.col("n") >= least), f"prints{size}")
        maps[size] = bitmap_of(many)
    shared = plain.sparkSession.sparkContext.broadcast(maps)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "size", "phrase", "n"]
        for batch in text_chunks(batches, "text", CHUNK):
            words = Words(batch.column(0), batch.column(1), bits)
            totals = np.bincount(words.lang, minlength=len(words.langs))
            yield pa.RecordBatch.from_arrays([
                words.langs.cast(pa.string()), pa.array(np.zeros(len(totals), np.int32)),
                pa.array([""] * len(totals), pa.string()), pa.array(totals, pa.int64())], names=names)
            for size in range(1, LONGEST + 1):
                at, prints = words.frequent_runs(size, shared.value)
                held = marked(shared.value[size], prints)
                for pointer, count in verified(words, at[held], prints[held], size):
                    yield pa.RecordBatch.from_arrays([
                        words.langs.cast(pa.string()).take(pa.array(words.lang[pointer])),
                        pa.array(np.full(len(pointer), size, np.int32)),
                        _strings(words.packed.buffer, *words.packed.spans(pointer, pointer + size - 1)),
                        pa.array(count, pa.int64())], names=names)

    found = plain.mapInArrow(work, "lang string, size int, phrase string, n bigint")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(
        (F.col("n") >= least) | ((F.col("size") == 0) & (F.col("n") > 0)))


def _score(a: str, left: Column, right: Column) -> Column:
    million = F.lit(1000000).cast("decimal(7,0)")
    whole = F.col(a).cast("decimal(18,0)")
    return F.call_function("div", million * (whole * whole), left.cast("decimal(18,0)") * right.cast("decimal(18,0)"))


def scored(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and more words that no longer phrase covers."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    candidates = phrases.filter("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", cut)
    sides = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit("r").alias("side"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("part")))).alias("s")
    parts = candidates.select("lang", "phrase", "a", "k", sides).select("lang", "phrase", "a", "k", "s.side", "s.part")
    known = phrases.filter("size > 0").select("lang", F.col("phrase").alias("part"), "n")
    met = join_spread(parts, known, ["lang", "part"])
    cuts = met.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(_score("a", F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    longer = F.explode(F.array(F.slice(words, F.lit(1), F.col("size") - 1), F.slice(words, F.lit(2), F.col("size") - 1)))
    inside = phrases.filter("size > 2").select("lang", "n", longer.alias("w")).select(
        "lang", F.array_join("w", " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("over"))
    return lowest.join(inside, ["lang", "phrase"], "left").filter(
        F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a"))).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    Counts by level of score (at most ``LEVELS`` * 21 a language) tell the level below which no phrase can be among them. What is
    left is ranked among a share of a language's phrases, then among the at most ``SALTS`` * ``top`` that remain.
    """
    phrases = settle(frequent_phrases(docs, text, lang, least, bits), "phrases")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", "salt").orderBy(*best)
    levelled = settle(scored(phrases).withColumn("level", F.floor(F.log2(F.col("score") + 1) * LEVELS)), "scored")
    upward = Window.partitionBy("lang").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    cuts = settle(levelled.groupBy("lang", "level").agg(F.count("*").alias("held")).withColumn(
        "above", F.coalesce(F.sum("held").over(upward), F.lit(0))).filter(F.col("above") < top).groupBy("lang").agg(F.min("level").alias("cut")), "cuts")
    left = levelled.join(cuts, "lang").filter(F.col("level") >= F.col("cut")).withColumn(
        "salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    totals = phrases.filter("size = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM texts)),
runs AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM pieces
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM pieces),
f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.phrase, c.a, x.k, l.a AS l, r.a AS r,
    (1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS score
    FROM c, (VALUES (1), (2)) AS x(k), f l, f r WHERE x.k < c.m AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:x.k], ' ') AND r.phrase = array_to_string(c.w[x.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3),
kept AS (SELECT * FROM lowest z WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = z.lang AND i.phrase = z.phrase AND 100 * i.a >= 50 * z.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op12_phrase_fingerprints": op12_phrase_fingerprints}
ORACLES = {"op12_phrase_fingerprints": ORACLE}
