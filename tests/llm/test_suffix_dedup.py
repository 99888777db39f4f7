from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from speakable.llm import queries
from speakable.llm.suffix_dedup import bounded_prefixes, fragments, kept_bytes, remove_repeats, repeated_starts, rotation_order, window_least


def plain(rows, length):
    """Every window of every text in one table."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_rotations_and_common_prefixes():
    rng = random.Random(1)
    for depth in (3, 10, 40):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 300))) + bytes([254])
        order = rotation_order(np.frombuffer(data, np.uint8), depth)
        turn = [data[i:] + data[:i] for i in order]
        assert [t[:depth] for t in turn] == sorted(t[:depth] for t in turn)
        got = bounded_prefixes(np.frombuffer(data, np.uint8)[order - 1], depth)
        for k in range(1, len(data)):
            common = next(j for j in range(len(data) + 1) if j == len(data) or turn[k][j] != turn[k - 1][j])
            assert got[k] == min(common, depth)


def test_repeated_starts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 6))]
        seen = Counter(t[k : k + 5] for t in texts for k in range(len(t) - 4))
        for t, flags in zip(texts, repeated_starts(texts, 5), strict=True):
            assert flags.tolist() == [seen[t[k : k + 5]] > 1 for k in range(max(len(t) - 4, 0))]


def test_window_least():
    values = np.random.default_rng(3).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 7, 50, 200):
        assert window_least(values, width).tolist() == [int(values[i : i + width].min()) for i in range(201 - width)]


def test_fragments_cover_every_window_once():
    rng = random.Random(4)
    run = [bytes(rng.choice(b"abcdef ") for _ in range(n)) for n in (0, 19, 20, 500, 21)] + [b"a" * 300]
    which, start, n, h, d = fragments(run, 20, 6)
    for i, t in enumerate(run):
        own = [w for k in np.flatnonzero(which == i) for w in range(start[k], start[k] + n[k])]
        assert own == list(range(max(len(t) - 19, 0)))


@pytest.mark.parametrize("most_classes", [4096, 1])
def test_removal_equals_brute_force(spark, most_classes):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(40)
    texts = [f"{text(rng.randrange(30))} {shared} {text(rng.randrange(30))}" for _ in range(12)]
    texts += [f"{shared} {text(50)} {shared}", text(200), None, "", "short", "ab" * 200, "x" * 90, texts[0], texts[0][:-5] + "tail", text(60) + shared[3:60] + text(5)]
    rows = list(enumerate(texts)) + [(None, texts[3]), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, h int")
    out = remove_repeats(docs, 40, seed=12, most_classes=most_classes)
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()], key=str)
    assert got == plain(rows, 40)
    assert sum(r[2] for r in got) > 1000 and any(r[3] > 1 for r in got)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted([tuple(r) for r in queries.op1_suffix_dedup(spark, sf).collect()], key=str)
    assert got == plain([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 200)


def test_kept_bytes_joins_spans_that_touch():
    spans = [{"start": 10, "n": 1}, {"start": 15, "n": 1}, {"start": 16, "n": 2}, {"start": 40, "n": 1}]
    data = bytes(range(60))
    assert kept_bytes(data, spans, 5) == (data[:10] + data[22:40] + data[45:], 2)
    assert kept_bytes(data, [], 5) == (data, 0)


def test_very_long_text(spark):
    half = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, half + " middle " + half), (2, "y" * 5_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (2 * len(half), 2) and (got[2].n_removed, got[2].n_spans) == (5_000, 1)


def test_ids_may_be_text(spark):
    same = "".join(chr(97 + i * i % 23) + str(i) for i in range(120))
    rows = [("a", f"first {same}"), ("b", f"second {same} end"), (None, same), ("c", "short")]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    want = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [want[k] for k in range(4)] and got["a"] >= len(same)
