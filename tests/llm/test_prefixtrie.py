"""The trie against one built node by node in Python; node tables on their own."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sightline.llm.prefixtrie import NodeTable, add_up, conversations, op13_prefix_trie, rebuilt, trie
from tests.conftest import MEDIUM, SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, a string, shard string, path string"


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, md5(md5(role or "") + (text or "")), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1] if p else "") + sum(saved[x] for x in children[p])
        ends = ",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def built(spark, rows, **kw):
    return got(trie(rebuilt(conversations(made(spark, rows))), **kw))


@pytest.fixture(scope="module")
def talk():
    rng = np.random.default_rng(7)
    rows = []
    for c in [*range(-120, 260), 400, 417, 5000]:
        for t in range(int(rng.integers(1, 8))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3))], ["hi", "é🙂", "", None][int(rng.integers(0, 4))]))
    return [*rows, (7, None, "user", "early"), (7, None, "user", "early"), (8, 1, "user", "tie"), (8, 1, "user", "other"),
            (None, 1, "user", "nobody"), (300, 0, "user", "alone"), (9, 5, "x", "a" * 100000)]


@pytest.mark.parametrize("bounds", [{}, {"parts": 10 ** 9, "least": 1}, {"least": 10 ** 9}])
def test_against_node_by_node(spark, talk, bounds):
    assert built(spark, talk, **bounds) == expected(talk)


def test_hot_turn_and_copies(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(0, 150) for t in range(6)]
    rows += [(c, t, "u", "same 0" if t == 0 else f"{c} {t}") for c in range(1000, 1300) for t in range(3)]
    assert built(spark, rows) == expected(rows)


def test_one_long_conversation(spark):
    rows = [(100, t, "u", f"turn {t}") for t in range(3000)] + [(101, t, "u", f"turn {t}") for t in range(8)]
    out = trie(rebuilt(conversations(made(spark, rows))))
    top = out.filter("depth = 0").collect()[0]
    assert (out.count(), top.n_convs) == (len(expected(rows[:40] + rows[3000:])) + 2960, 2)


def test_empty_table(spark):
    assert trie(rebuilt(conversations(made(spark, [])))).count() == 0
    assert trie(rebuilt(conversations(made(spark, [(None, 1, "u", "x")])))).count() == 0


def test_query(spark):
    for folder in (SMALL, MEDIUM):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert got(op13_prefix_trie(spark, folder)) == expected(rows)


def test_node_table_is_minimal_and_refuses_others():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    a[:50] = a[0]  # equal in one lane
    nodes = NodeTable(np.concatenate([a, a]), np.concatenate([b, b]))
    slots = nodes.slots(a, b)
    assert len(nodes) == 5000 and sorted(slots.tolist()) == list(range(5000))
    assert (nodes.slots(a, b + np.uint64(1)) == -1).all() and (nodes.slots(b, a) == -1).all()
    assert len(NodeTable(a[:0], b[:0])) == 0 and NodeTable(a[:0], b[:0]).slots(a, b).tolist() == [-1] * 5000


def test_add_up():
    parent, depth = np.array([-1, 0, 0, 1, -1]), np.array([0, 1, 1, 2, 1])
    sums = np.array([1, 10, 100, 1000, 7])
    add_up(parent, depth, [sums])
    assert sums.tolist() == [1111, 1010, 100, 1000, 7]
