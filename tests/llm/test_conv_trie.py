from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from speakable.llm import queries
from speakable.llm.conv_trie import DoubleArray, prefix_nodes, rebuilt_rows, turn_rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    """rows: (conv_id, turn, role, text) -> conv_id -> [(role, text)]."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    if not convs:
        return []
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(tuple(-1 if x is None else x for x in r) for r in rows)


def test_query_equals_plain_trie(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13_conv_trie(spark, sf)
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_nodes(plain_rebuilt(rows))
    assert order(tuple(r) for r in got.collect()) == order(want) and len(want) > 300


@pytest.mark.parametrize("deep, shard_turns", [(4, 3), (2, 1), (1024, 5)])
def test_shards_and_long_conversations(spark, deep, shard_turns):
    """Few turns a segment and a shard, so that there are many of both."""
    rng = random.Random(deep)
    rows = [(c, t, "u", rng.choice("aab") * (t + 1)) for c in range(0, 130) for t in range(rng.choice([0, 1, 3, 4, 7]))]
    rows += [(7, t, "u", "long") for t in range(20, 24)] + [(c, t, "u", "a" * (t + 1)) for c in range(200, 240) for t in range(7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in prefix_nodes(rebuilt_rows(docs), deep, shard_turns).collect()]
    assert order(got) == order(plain_nodes(plain_rebuilt(rows)))


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (1, None, None, None), (1, 2, "u", None), (1, 2, "u", None), (105, 1, "a", "b"), (100, 1, "a", "é" * 5), (2, 1, "long", "w " * 50_000), (9_007_199_254_740_993, 1, "", "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", depth string, digest int")
    got = [tuple(r) for r in prefix_nodes(rebuilt_rows(docs)).collect()]
    assert order(got) == order(plain_nodes(plain_rebuilt(rows)))
    own = defaultdict(list)
    for c, _, role, text in rows[1:]:
        own[c].append((role or "", text or ""))
    assert order(tuple(r) for r in prefix_nodes(turn_rows(docs)).collect()) == order(plain_nodes(own))
    empty = prefix_nodes(rebuilt_rows(docs.limit(0)))
    assert empty.columns == COLUMNS and empty.collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=6), max_size=30))
def test_double_array_holds_exactly_its_sequences(sequences):
    sequences = sorted(sequences)
    trie = DoubleArray(sequences)
    prefixes = {tuple(s[:d]) for s in sequences for d in range(1, len(s) + 1)}
    assert {tuple(s[: i + 1]): node for s in sequences for i, node in enumerate(trie.walk(s))}.keys() == prefixes
    assert len(set(trie.order)) == len(trie.order) == len(prefixes) + 1
    assert all(node == 0 or trie.check[node] in trie.order for node in trie.order)
