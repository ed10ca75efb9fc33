"""Prefix trie of conversations in minimal-perfect-hash node tables (operator 13).

A conversation becomes one row of turn digests (MD5 of role and text) and text lengths; texts are shuffled no further. Prefix
polynomials over the digests, in two lanes of 64 bits, give the digest of every prefix; equal digests are one node.

Shards are whole subtrees. A prefix that more than one in ``PARTS`` conversations share (and more than ``LEAST``) belongs to the crown;
at most ``PARTS`` times the mean length of a conversation prefixes can. Every other prefix goes to the shard of its first
prefix outside the crown, so a very common first turn, or a third of all conversations with equal texts, is
divided further down or met by partial aggregation in the crown. A shard enumerates its distinct digests, gives each one a slot of
a minimal perfect hash, whose slots keep the digest and refuse any other, scatters members, lengths and parents into flat
arrays by slot, and adds up subtrees through the array of parent slots, deepest first. The tops of the shards are then
added to the crown, which is one such table.

Ending members are hashed by runs of ``RUN`` ids, in order, one run at a time, so no list of members is ever held.

Defined cases: rows with a null conversation id belong to no conversation; null roles and texts are empty; null turns come first, equal
turns follow each other by digest; repeated rows are turns of their own; an empty table has no node, not even a root; other
columns are ignored. A conversation's digests (40 bytes a turn) stand in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import in_shuffle_partitions, mix, settle, table

PARTS = 1024
LEAST = 16
SHARD_ROWS = 50_000
RUN = 4096
HEAD = 6
BLOCK = 100
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

PREFIXES = "conv bigint, depth int, a bigint, b bigint, pa bigint, pb bigint, size bigint, ends boolean, shard int"
NODES = ("a bigint, b bigint, pa bigint, pb bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
NOTHING = hashlib.sha256(b"").hexdigest()

_NIBBLE = np.zeros(256, dtype=np.uint64)
_NIBBLE[[*b"0123456789abcdef"]] = np.arange(16, dtype=np.uint64)


class NodeTable:
    """A minimal perfect hash of digests: levels of bits, each for the keys that stand alone in it; slots are ranks of bits.

    ``slots`` returns the slot of a digest, or -1 for one that the table does not hold.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, done = np.arange(len(a)), 0
        while len(left):
            place = self._place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            rank = done + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            held = alone[place]
            slot = rank[place[held]]
            self.a[slot], self.b[slot] = a[left[held]], b[left[held]]
            done += int(held.sum())
            left = left[~held]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, width: int) -> np.ndarray:
        salt = np.array([(level + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1], dtype=np.uint64)
        return (mix(a ^ mix(b + salt)) % np.uint64(width)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, dtype=np.int64)
        left = np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(a[left], b[left], level, len(alone))
            hit = alone[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        known = out >= 0
        out[known] = np.where((self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known]), out[known], -1)
        return out

    def __len__(self) -> int:
        return len(self.a)


def add_up(parent: np.ndarray, depth: np.ndarray, sums: list[np.ndarray]) -> None:
    """Add every node's sums to those of its ancestors, in place; ``parent`` holds slots, -1 above the top."""
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        level = order[lo:hi]
        level = level[parent[level] >= 0]
        for x in sums:
            np.add.at(x, parent[level], x[level])


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path): each conversation's turns in order, as (digest, size)."""
    said, by = F.coalesce(df[text], F.lit("")), F.coalesce(df[role], F.lit(""))
    turns = df.filter(df[conv].isNotNull()).select(
        df[conv].cast("bigint").alias("conv"),
        F.struct(df[turn].isNotNull().alias("given"), df[turn].alias("turn"), F.md5(F.concat(F.md5(by), said)).alias("digest"),
                 F.char_length(said).cast("bigint").alias("size")).alias("t"))
    ordered = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("path"))
    return ordered.select("conv", F.transform("path", lambda t: F.struct(t["digest"], t["size"])).alias("path"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv, path): the first turns of the first conversation of the block, then the conversation's own after as many."""
    first = convs.filter(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("base"), F.slice("path", 1, HEAD - 1).alias("head"))
    named = convs.select("conv", "path", (F.crc32(F.col("conv").cast("string")) % HEAD).cast("int").alias("h"),
                         (F.col("conv") - F.col("conv") % BLOCK).alias("base"))
    own = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return named.join(first, "base", "left").select(
        "conv", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("path", 1, 0)), own).alias("path"))


class Paths:
    """The prefixes of a batch of conversations: a row for each depth from 0."""

    def __init__(self, batch: pa.RecordBatch):
        conv, lists = batch.column(0).to_numpy(), batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        turns = lists.values.slice(ends[0], ends[-1] - ends[0]).flatten()
        ends = ends - ends[0]
        lanes = self._lanes(turns[0])
        count = np.diff(ends)
        of = np.repeat(np.arange(len(conv)), count)
        place = np.arange(ends[-1]) - ends[of]
        rows = ends + np.arange(len(ends))  # first row of every conversation: its root
        self.conv = np.repeat(conv, count + 1)
        self.depth = np.arange(rows[-1]) - np.repeat(rows[:-1], count + 1)
        turn = np.flatnonzero(self.depth > 0)
        self.size = np.zeros(rows[-1], dtype=np.int64)
        self.size[turn] = turns[1].to_numpy()
        self.ends = np.zeros(rows[-1], dtype=bool)
        self.ends[rows[1:] - 1] = True
        self.first = rows
        self.lanes = []
        for lane, base in zip(lanes, BASES):
            power = np.full(int(count.max(initial=0)) + 1, base, dtype=np.uint64)
            power[:1] = 1
            np.cumprod(power, out=power)
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(lane) * power[place], dtype=np.uint64)])
            digest = np.zeros(rows[-1], dtype=np.uint64)
            digest[turn] = mix(run[1:] - run[ends[of]] + self.depth[turn].astype(np.uint64) * np.uint64(BASES[0] ^ BASES[1] | 1))
            self.lanes.append(digest)
        self.parents = []
        for digest in self.lanes:
            above = np.zeros_like(digest)
            above[turn] = digest[turn - 1]
            self.parents.append(above)

    @staticmethod
    def _lanes(digests: pa.Array) -> list[np.ndarray]:
        text = b"".join(x.as_buffer() for x in digests) if len(digests) else b""
        nibbles = _NIBBLE[np.frombuffer(text, np.uint8)].reshape(-1, 2, 16)
        shifts = np.arange(60, -4, -4, dtype=np.uint64)
        packed = (nibbles << shifts).sum(axis=2, dtype=np.uint64)
        return [np.ascontiguousarray(packed[:, 0]), np.ascontiguousarray(packed[:, 1])]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def prefixes(paths: DataFrame, crown: tuple[np.ndarray, np.ndarray] | None = None, shards: int = 1) -> DataFrame:
    """A row for every prefix of every conversation; ``shard`` is -1 for those in the crown."""
    shared = paths.sparkSession.sparkContext.broadcast(crown)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = NodeTable(*shared.value) if shared.value is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = Paths(batch)
            a, b = p.lanes
            shard = np.zeros(len(a), dtype=np.int32)
            if top is not None:
                held = (top.slots(a, b) >= 0) | (p.depth == 0)
                inside = np.add.reduceat(held.astype(np.int64), p.first[:-1])
                per = np.diff(p.first)
                start = np.minimum(p.first[:-1] + inside, p.first[1:] - 1)
                own = (mix(a[start]) % np.uint64(shards)).astype(np.int32)
                shard = np.where(p.depth < np.repeat(inside, per), np.int32(-1), np.repeat(own, per))
            yield pa.RecordBatch.from_arrays([
                pa.array(p.conv), pa.array(p.depth.astype(np.int32)), _signed(a), _signed(b), _signed(p.parents[0]), _signed(p.parents[1]),
                pa.array(p.size), pa.array(p.ends), pa.array(shard)],
                names=["conv", "depth", "a", "b", "pa", "pb", "size", "ends", "shard"])

    return paths.mapInArrow(work, PREFIXES)


def _columns(group: pa.Table, *names: str) -> list[np.ndarray]:
    out = [group.column(c).to_numpy() for c in names]
    return [x.view(np.uint64) if c in ("a", "b", "pa", "pb") else x for c, x in zip(names, out)]


def _listed(nodes: NodeTable, parent: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: np.ndarray, depth: np.ndarray,
            members: np.ndarray, children: np.ndarray, leaves: np.ndarray, saved: np.ndarray, ends: list[str]) -> pa.Table:
    return pa.table({
        "a": _signed(nodes.a), "b": _signed(nodes.b), "pa": _signed(pa_), "pb": _signed(pb), "conv_id": least,
        "depth": depth.astype(np.int64), "parent_conv_id": pa.array(least[parent], mask=parent < 0), "n_convs": members,
        "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(ends, pa.string())})


def _above(nodes: NodeTable, slot: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent slots and parent digests by slot."""
    above_a, above_b = np.zeros(len(nodes), np.uint64), np.zeros(len(nodes), np.uint64)
    above_a[slot], above_b[slot] = pa_, pb
    return nodes.slots(above_a, above_b), above_a, above_b


def shard_nodes(group: pa.Table) -> pa.Table:
    """The nodes of a shard from its prefixes."""
    conv, depth, a, b, pa_, pb, size, ends = _columns(group, "conv", "depth", "a", "b", "pa", "pb", "size", "ends")
    nodes = NodeTable(a, b)
    slot, n = nodes.slots(a, b), len(nodes)
    parent, above_a, above_b = _above(nodes, slot, pa_, pb)
    members = np.bincount(slot, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    level, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    level[slot], length[slot] = depth, size
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * length
    add_up(parent, level, [leaves, saved])
    hashed = [NOTHING] * n
    last = np.flatnonzero(ends)
    last = last[np.lexsort((conv[last], slot[last]))]
    cuts = np.flatnonzero(np.diff(slot[last])) + 1
    for run in np.split(last, cuts) if len(last) else []:
        hashed[slot[run[0]]] = hashlib.sha256(",".join(map(str, conv[run].tolist())).encode()).hexdigest()
    return _listed(nodes, parent, above_a, above_b, least, level, members, children, leaves, saved, hashed)


def crown_nodes(group: pa.Table) -> pa.Table:
    """The nodes of the crown from one row each, with what the shards below add."""
    a, b, pa_, pb, least, depth, members, size, tops, below, spared = _columns(
        group, "a", "b", "pa", "pb", "conv", "depth", "n", "size", "tops", "below", "spared")
    nodes = NodeTable(a, b)
    slot = nodes.slots(a, b)

    def by_slot(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), np.int64)
        out[slot] = x
        return out

    least, level, members, size, tops, leaves, spared = map(by_slot, (least, depth, members, size, tops, below, spared))
    parent, above_a, above_b = _above(nodes, slot, pa_, pb)
    parent[level == 0] = -1
    children = np.bincount(parent[parent >= 0], minlength=len(nodes)) + tops
    leaves[children == 0] = 1
    saved = (members - 1) * size + spared
    add_up(parent, level, [leaves, saved])
    ends = [""] * len(nodes)
    for s, x in zip(slot.tolist(), group.column("ends").to_pylist()):
        ends[s] = x
    return _listed(nodes, parent, above_a, above_b, least, level, members, children, leaves, saved, ends)


def _hashed_ends(last: DataFrame) -> DataFrame:
    """(a, b, ends): SHA-256 of the ending members of a prefix, ascending and comma-joined."""
    runs = last.groupBy("a", "b", F.floor(F.col("conv") / RUN).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["a", "b", "ends"])

        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != at:
                    if at is not None:
                        yield closed()
                    at, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if at is not None:
            yield closed()

    return runs.repartition("a", "b").sortWithinPartitions("a", "b", "run").mapInArrow(work, "a bigint, b bigint, ends string")


def trie(paths: DataFrame, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """The nodes of the trie of (conv, path) rows."""
    spark = paths.sparkSession
    paths = settle(paths, "paths")
    bound = max(least, paths.count() // parts)
    common = prefixes(paths).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > bound).select("a", "b").toArrow()
    rows = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    shards = max(in_shuffle_partitions(spark), -(-rows // SHARD_ROWS))
    held = settle(prefixes(paths, tuple(_columns(common, "a", "b")), shards), "prefixes")
    low = settle(held.filter("shard >= 0").groupBy("shard").applyInArrow(shard_nodes, NODES), "nodes")
    top = held.filter("shard < 0")
    counted = top.groupBy("a", "b").agg(
        F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n"), F.max("size").alias("size"),
        F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    below = low.filter("parent_conv_id IS NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("tops"), F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("spared"))
    zero = F.lit(0).cast("bigint")
    one = counted.join(below, ["a", "b"], "left").join(_hashed_ends(top.filter("ends")), ["a", "b"], "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("tops", "below", "spared")}).withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    crown = settle(one.groupBy(F.lit(0).alias("crown")).applyInArrow(crown_nodes, NODES), "crown")
    above = F.broadcast(crown.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above")))
    named = low.join(above, ["pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")
    return named.unionByName(crown).drop("a", "b", "pa", "pb")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = settle(conversations(table(spark, sf_dir, "conversations")), "conversations")
    return trie(rebuilt(convs))


#: CRC32 of the decimal id: a list of its bytes, each followed by eight shifts, folded over the register.
ORACLE = """
WITH turns AS (SELECT conv_id AS c, turn, md5(md5(coalesce(role, '')) || coalesce(text, '')) AS g, length(coalesce(text, '')) AS z
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'g': g, 'z': z} ORDER BY turn NULLS FIRST, g) AS own, CAST(c AS VARCHAR) AS s FROM turns GROUP BY c),
sized AS (SELECT c, own, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 6 AS h FROM own),
paths AS (SELECT o.c, list_concat(CASE WHEN o.h = 0 OR b.own IS NULL THEN [] ELSE b.own[1:o.h] END, o.own[o.h + 1:]) AS path
    FROM sized o LEFT JOIN own b ON b.c = o.c - o.c % 100),
rows AS (SELECT c, d, array_to_string(list_transform(path[1:d], lambda x: x.g), '') AS p, CASE WHEN d > 0 THEN path[d].z ELSE 0 END AS z,
    d = len(path) AS fin FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(z) AS z,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE fin), '')) AS e FROM rows GROUP BY p, d),
kids AS (SELECT substr(p, 1, (d - 1) * 32) AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (p, d)),
sums AS (SELECT substr(p, 1, j * 32) AS p, j AS d, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * z) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM full_) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, f.e AS ends_sha256
FROM full_ f JOIN sums s ON s.p = f.p AND s.d = f.d LEFT JOIN nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.p = substr(f.p, 1, (f.d - 1) * 32)
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": ORACLE}
