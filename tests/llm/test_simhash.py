from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from speakable.llm import queries
from speakable.llm.simhash import GrayForest, components, fingerprint, gray_rank, links, masks, near_duplicates, one_per_group

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    k = min(k, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, distance):
    """Smallest member of the component of each value, by all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {v: top(v) for v in values}


def cloud(rng, centres, each, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            v = c
            for _ in range(rng.randrange(flips + 1)):
                v ^= 1 << rng.randrange(64)
            out.append(v)
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", ["", "  ", "One", "a b c", "a b c d", "A É é Z\n\tq a b", "x " * 50, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4"])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 4) == plain(text)


def test_masks_leave_no_pair_out():
    rng = random.Random(3)
    for d in (3, 4, 6):
        assert all(sum(1 for _ in bin(m & (1 << 64) - 1)) for m in masks(d))
        for _ in range(500):
            flip = sum(1 << b for b in rng.sample(range(64), d))
            assert any((flip & m) == 0 for m in masks(d))


def test_forest_equals_all_pairs():
    rng = random.Random(7)
    for d in (0, 2, 4, 7):
        buckets = [cloud(rng, rng.randrange(1, 6), rng.randrange(1, 120), 9) for _ in range(6)]
        bucket, bits = [], []
        for i, values in enumerate(buckets):
            values = np.array(sorted(set(values)), np.uint64)
            values = values[np.argsort(gray_rank(values))]
            bucket += [i] * len(values)
            bits += values.tolist()
        first = GrayForest(np.array(bucket), np.array(bits, np.uint64)).components(d)
        for i, values in enumerate(buckets):
            want = roots(values, d)
            own = [k for k, x in enumerate(bucket) if x == i]
            groups = {}
            for k in own:
                groups.setdefault(first[k], set()).add(bits[k])
            other = {}
            for v, r in want.items():
                other.setdefault(r, set()).add(v)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


@pytest.mark.parametrize("bucket_rows", [16_384, 40])
def test_links_and_components_equal_all_pairs(spark, bucket_rows):
    rng = random.Random(11)
    values = sorted({signed(v) for v in cloud(rng, 12, 60, 8) + [rng.getrandbits(64) for _ in range(300)]})
    prints = spark.createDataFrame([(v,) for v in values], "bits long")
    found = {r.node: r.root for r in components(links(prints, 4, bucket_rows)).collect()}
    full = (1 << 64) - 1
    want = roots([v & full for v in values], 4)
    mine = {}
    for v in values:
        mine.setdefault(found.get(v, v), set()).add(v & full)
    other = {}
    for v, r in want.items():
        other.setdefault(r, set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, other.values()))
    assert any(len(x) > 20 for x in other.values())


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf).collect()}
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    root = roots(docs.values(), 4)
    first = {}
    for i, v in sorted(docs.items()):
        first.setdefault(root[v], i)
    assert got == {i: (f"{v:016x}", first[root[v]]) for i, v in docs.items()}
    assert len(set(c for _, c in got.values())) < len(got)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(4, None), (2, ""), (9, "\n"), (None, "alone here"), (7, "same text of words"), (5, "same text of words"), (5, "same text of words"), (8, long), (None, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bits int, root string")
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(by[2], key=str) == [2, 4, 9, None] and sorted(by[5]) == [5, 5, 7] and by[8] == [8] and by[None] == [None]
    kept = one_per_group(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.bits, r.root) for r in kept] == [(None, "alone here", 1, "x"), (2, "", 1, "x"), (5, "same text of words", 1, "x"), (8, long, 1, "x")]
    assert near_duplicates(docs.filter(F.lit(False))).count() == 0 and one_per_group(docs.limit(0)).count() == 0
