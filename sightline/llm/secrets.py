"""Secret scan with corpus-wide ownership frequency (operator 4); DataFrame functions only.

Three patterns find candidate spans in the whole text. Every candidate value is hashed, and the hashes are counted over
the corpus by distinct repository and owner. A value held by ``EXAMPLE_OWNERS`` owners or more is a widely copied example;
one held by fewer, with at least ``LIVE_CHARACTERS`` different characters, is a live-looking credential of its
owner. The method adds a span ``example`` or ``live`` over the value to the spans of the patterns, which stay.

Offsets are code points, ends exclusive. Defined cases: a null text counts as empty; an empty or spanless text has
counts of 0, empty ``spans`` and the hash of the empty string; a null owner is one owner of its own, a null key one
repository; repeated rows each give a row and count once as a repository; other columns are ignored by ``scan`` and kept by
``redact``. A value that fills a third of all rows is counted by (value, owner, repository) first, so no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import settle, table

EXAMPLE_OWNERS = 3
LIVE_CHARACTERS = 6
#: Kind, pattern, group of the value, least length of that group.
PATTERNS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # maximal runs of 16 and more: the same as runs of any length with the short ones dropped
)
#: Every match of "assign" holds one of these in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "live", "example")
SPAN = "array<struct<start:int,kind:int,end:int,vstart:int,value:string,alive:boolean>>"


def _running(steps: Column) -> Column:
    """Sum of the steps before each one; by blocks of 64, so a text with very many matches stays cheap."""
    blocks = F.when(F.size(steps) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int")), lambda b: F.slice(steps, b * 64 + 1, F.lit(64)))
    ).otherwise(F.array().cast("array<array<int>>"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    return F.flatten(F.transform(blocks, lambda x, b: F.transform(
        x, lambda v, i: total(F.slice(x, F.lit(1), i)) + total(F.transform(F.slice(blocks, F.lit(1), b), total)))))


def _guard(kind: str, text: Column) -> Column:
    if kind == "assign":
        low = F.lower(text)
        held = F.lit(False)
        for word in ASSIGN_WORDS:
            held = held | F.contains(low, F.lit(word))
        return held
    return F.contains(text, F.lit("AKIA")) if kind == "access" else F.lit(True)


def _span(kind: str, number: int):
    def made(i: Column) -> Column:
        start = F.get(f"{kind}_before", i) + F.get(f"{kind}_gaps", i)
        end = F.get(f"{kind}_before", i) + F.get(f"{kind}_steps", i)
        value = F.get(f"{kind}_values", i)
        return F.struct(
            start.alias("start"), F.lit(number).alias("kind"), end.alias("end"),
            (end - F.char_length(value)).alias("vstart"), F.sha2(value, 256).alias("value"),
            (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS).alias("alive"))

    return made


def _long_enough(least: int):
    return lambda s: s["end"] - s["vstart"] >= F.lit(least)


def with_spans(rows: DataFrame, text: str) -> DataFrame:
    """Add ``found``: all pattern spans of a text, in order of start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = rows
    for kind, pattern, group, _ in PATTERNS:
        seen = _guard(kind, body)
        empty = F.array().cast("array<string>")
        out = out.withColumns({
            f"{kind}_hits": F.when(seen, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(empty),
            f"{kind}_values": F.when(seen, F.regexp_extract_all(body, F.lit(pattern), F.lit(group))).otherwise(empty),
        })
    for kind, pattern, _, _ in PATTERNS:
        some = F.size(f"{kind}_hits") > 0
        gaps = F.transform(F.split(body, pattern, -1), F.char_length)
        out = out.withColumn(f"{kind}_gaps", F.when(some, F.slice(gaps, F.lit(1), F.size(f"{kind}_hits"))).otherwise(
            F.array().cast("array<int>")))
    for kind, _, _, _ in PATTERNS:
        out = out.withColumn(f"{kind}_steps", F.zip_with(f"{kind}_gaps", f"{kind}_hits", lambda g, h: g + F.char_length(h)))
    for kind, _, _, _ in PATTERNS:
        out = out.withColumn(f"{kind}_before", _running(F.col(f"{kind}_steps")))
    for number, (kind, _, _, least) in enumerate(PATTERNS):
        place = F.sequence(F.lit(0), F.size(f"{kind}_hits") - 1)
        spans = F.filter(F.transform(place, _span(kind, number)), _long_enough(least))
        out = out.withColumn(f"{kind}_spans", F.when(F.size(f"{kind}_hits") > 0, spans).otherwise(F.array()).cast(SPAN))
    found = F.array_sort(F.concat(*[F.col(f"{kind}_spans") for kind, *_ in PATTERNS]))
    return out.withColumn("found", found).select(*rows.columns, "found")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, owners, repositories) from (value, owner, repo) rows of any multiplicity."""
    once = candidates.distinct()
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _added(hits: DataFrame, frequency: DataFrame) -> DataFrame:
    """(key, th, added): the spans that the method adds to each text."""
    rows = hits.select("key", "th", F.explode("found").alias("s")).select(
        "key", "th", F.col("s.vstart").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"),
        F.col("s.alive").alias("alive")).distinct()
    judged = rows.join(frequency, "value").select("key", "th", "start", "end", F.when(
        F.col("owners") >= EXAMPLE_OWNERS, F.lit(4)).when(F.col("alive"), F.lit(3)).alias("kind"))
    return judged.filter(F.col("kind").isNotNull()).groupBy("key", "th").agg(
        F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _scanned(docs: DataFrame, key: str, owner: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(spans of every row, spans added to the rows that have any)."""
    rows = docs.select(docs[key].alias("key"), F.coalesce(docs[owner].cast("string"), F.lit("\0")).alias("owner"),
                       _text_hash(docs[text]).alias("th"), docs[text].alias("text"))
    spans = settle(with_spans(rows, "text").select("key", "owner", "th", "found"), "secret-spans")
    hits = spans.filter(F.size("found") > 0)
    candidates = hits.select(F.explode("found.value").alias("value"), "owner", F.col("key").alias("repo"))
    return spans, _added(hits, ownership(candidates))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """Counts, digest and spans of every row."""
    spans, added = _scanned(docs, key, owner, text)
    short = "array<struct<start:int,kind:int,end:int>>"
    base = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    def shown(rows: DataFrame) -> DataFrame:
        def count(k: int) -> Column:
            return F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("bigint")

        return rows.withColumn("base", base).select(
            F.col("key").alias(key), *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
            F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
            _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))

    none = F.array().cast(short)
    held = spans.filter(F.size("found") > 0).alias("a").join(
        added.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.th") == F.col("b.th")), "left"
    ).select("a.key", "a.found", F.coalesce(F.col("b.added"), none).alias("added"))
    rest = spans.filter(F.size("found") == 0).select("key", "found", none.alias("added"))
    return shown(held.unionByName(rest))


def redact(docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text",
           length: str | None = None) -> DataFrame:
    """All rows and columns, with each found value in ``text`` replaced by ``[SECRET]``, or ``[EXAMPLE]`` where it is widely copied.

    Rows without spans pass through without a shuffle. ``length`` names a column that holds the number of characters.
    """
    _, added = _scanned(docs, key, owner, text)
    held = docs.select(F.struct(*docs.columns).alias("row"), docs[key].alias("key"), docs[text].alias("text"),
                       _text_hash(docs[text]).alias("th"))
    # A plain test of the text, so that the spans are worked out once, and only for rows that may have some.
    may = F.lit(False)
    for kind, pattern, _, _ in PATTERNS:
        may = may | (_guard(kind, F.col("text")) & F.col("text").rlike(pattern))
    marked = held.withColumn("may", F.coalesce(may, F.lit(False)))
    values = F.transform("found", lambda s: F.struct(s["vstart"].alias("start"), s["end"].alias("end")))
    hits = with_spans(marked.filter("may"), "text").withColumn("spans", F.array_sort(F.array_distinct(values)))
    a, b = hits.alias("a"), added.alias("b")
    joined = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.th") == F.col("b.th")), "left")

    def replaced() -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            example = F.exists(F.col("b.added"), lambda x: (x["kind"] == 4) & (x["start"] == s["start"]) & (x["end"] == s["end"]))
            mark = F.when(F.coalesce(example, F.lit(False)), F.lit("[EXAMPLE]")).otherwise(F.lit("[SECRET]"))
            clear = F.substring(F.col("a.text"), acc["at"] + 1, s["start"] - acc["at"])
            return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(
                F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(clear, mark)).alias("parts")))

        done = F.aggregate(F.col("a.spans"), start, step)
        return F.concat(F.array_join(done["parts"], ""), F.substring(F.col("a.text"), done["at"] + 1, F.lit(2147483647)))

    changed = joined.select("a.row", replaced().alias("text"), (F.size("a.spans") > 0).alias("new"))
    kept = marked.filter(~F.col("may")).select("row", "text", F.lit(False).alias("new"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("text").alias(c)
        if c == length:
            return F.when(F.col("new"), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return changed.union(kept).select(*[column(c) for c in docs.columns])


def op4_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The scan of ``documents`` as DuckDB SQL: places of matches from the lengths of the pieces between them."""
    found = " UNION ALL ".join(
        f"""SELECT rid, doc_id, owner, {k} AS kind, {least} AS least, unnest(range(1, len(hits) + 1)) AS i, hits, vals, gaps FROM (
          SELECT rid, doc_id, owner, regexp_extract_all(t, '{q}', 0) AS hits, regexp_extract_all(t, '{q}', {group}) AS vals,
            string_split_regex(t, '{q}') AS gaps FROM d)""" for k, (_, pattern, group, least) in enumerate(PATTERNS)
        for q in [pattern.replace("'", "''")])
    names = "['" + "', '".join(KINDS) + "'][kind + 1]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner FROM documents),
m AS ({found}),
p AS (SELECT rid, doc_id, owner, kind, least, length(hits[i]) AS size, vals[i] AS value,
    sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM m),
c AS (SELECT rid, doc_id, owner, kind, stop - size AS start, stop, stop - length(value) AS vstart, value FROM p WHERE length(value) >= least),
f AS (SELECT value, count(DISTINCT owner) AS owners FROM c GROUP BY value),
a AS (SELECT DISTINCT rid, vstart AS start, CASE WHEN owners >= {EXAMPLE_OWNERS} THEN 4
    WHEN len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} THEN 3 END AS kind, stop FROM c JOIN f USING (value)),
s AS (SELECT rid, start, kind, stop FROM c UNION ALL SELECT rid, start, kind, stop FROM a WHERE kind IS NOT NULL),
j AS (SELECT rid, string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans,
    string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base,
    count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2 FROM s GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)"""


QUERIES = {"op4_ownership_secrets": op4_ownership_secrets}
ORACLES = {"op4_ownership_secrets": _oracle()}
