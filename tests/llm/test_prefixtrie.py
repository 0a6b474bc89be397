"""op12 against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import prefixtrie
from skein.operators import scan

rng = random.Random(12)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, owner string"


def brute(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]) if heads else tuple(turns)
    members, ends = defaultdict(set), defaultdict(list)
    for c, p in path.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[q] for q in children[p])
        leaves[p] = sum(leaves[q] for q in children[p]) if children[p] else 1
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items())


def found(nodes):
    cells = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cells) for r in nodes.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)


def conversations(n, hot=0):
    says = ["hi", "hello", None, "", "日本", "a longer text of a turn"]
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(says)) for t in range(rng.randrange(1, 12))]
    rows += [(n + i, t, "user", f"same {t}") for i in range(hot) for t in range(9)]  # copies
    return rows


ODD = [(None, 1, "user", "no id"), (501, None, "user", "first"), (501, 1, "user", "second"), (502, 3, None, None), (503, 0, "user", "x" * 20000), (700, 5, "a", "b"), (700, 5, "a", "b"), (-3, 1, "user", "hi"), (-5, 1, "user", "ho"), (0, 50, "user", "later")]


@pytest.mark.parametrize("hot", [0, 60])
def test_equal_to_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(scan, "FEW", 15)  # some keys count as having many rows
    monkeypatch.setattr(prefixtrie, "PIECE", 21 * 7)  # ids of one node come in several strings
    rows = conversations(120, hot) + ODD
    turns = prefixtrie.turns(table(spark, rows))
    assert found(prefixtrie.trie(*prefixtrie.with_shared_heads(turns))) == brute(rows)


def test_conversations_as_they_are(spark):
    rows = conversations(60) + [(1000, t, "user", f"turn {t}") for t in range(400)]  # one holds half of all turns
    turns = prefixtrie.turns(table(spark, rows))
    assert found(prefixtrie.trie(turns, prefixtrie.lengths(turns))) == brute(rows, heads=False)


def test_conversations_without_turns(spark):
    c = next(c for c in range(1, 10_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(c, 0, "user", "goes with the head that is not there")]
    turns = prefixtrie.turns(table(spark, rows))
    assert found(prefixtrie.trie(*prefixtrie.with_shared_heads(turns))) == brute(rows)


def test_empty_table(spark):
    turns = prefixtrie.turns(table(spark, []))
    assert prefixtrie.trie(*prefixtrie.with_shared_heads(turns)).count() == 0


def test_hashes_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 21 * 50)
    ends = spark.range(5000).select((F.col("id") % 2).alias("depth"), (F.col("id") % 3).alias("_a"), F.lit(1).cast("bigint").alias("_b"), F.col("id").alias("conv_id")).repartition(5)
    got = {(r.depth, r._a): r.ends_sha256 for r in prefixtrie.hashes_of_ends(ends).collect()}
    want = {(d, a): hashlib.sha256(",".join(str(i) for i in range(5000) if i % 2 == d and i % 3 == a).encode()).hexdigest() for d in range(2) for a in range(3)}
    assert got == want
