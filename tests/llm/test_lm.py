from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from speakable.llm import queries
from speakable.llm.lm import MU, Automaton, Block, _bucket, _narrow, _wide, lm_scores

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain(rows, order=2):
    """doc_id -> (n_tokens, n_known, N, base, score), with dictionaries and one pass per text."""
    seen = Counter()
    for _, text, train in rows:
        if train:
            words = [None, *words_of(text)]
            for k in range(1, order + 1):
                # The end before a text is part of longer sequences, but counts once, as the end of a text.
                seen.update(tuple(words[i - k : i]) for i in range(k + (k == 1), len(words) + 1))
    one = {k[0]: c for k, c in seen.items() if len(k) == 1}
    n, v = sum(one.values()), len(one)
    p = lambda w: (one.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    def log_p(context, w):
        if not context:
            return math.log10(p(w))
        if seen[(*context, w)]:
            prob = p(w)
            for k in range(len(context) - 1, -1, -1):
                prob = (seen[(*context[k:], w)] + MU * prob) / (seen[context[k:]] + MU)
            return math.log10(prob)
        return math.log10(MU / (seen[context] + MU)) + log_p(context[1:], w)

    out = []
    for i, text, _ in rows:
        words = words_of(text)
        base = math.fsum(math.log10(p(w)) for w in words)
        score = math.fsum(log_p(tuple([None, *words][max(0, k + 2 - order) : k + 1]), w) for k, w in enumerate(words))
        out.append((i, len(words), sum(one.get(w, 0) > 0 for w in words), n, base, score))
    return out


def same(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("block_bytes", "order"), [(24_000_000, 2), (60_000, 2), (60_000, 3), (24_000_000, 4), (60_000, 1)])
def test_equals_plain_python(spark, block_bytes, order):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", (queries.fold(queries.F.col("doc_id"), 5) != 1).alias("train"))
    out = lm_scores(docs, block_bytes=block_bytes, order=order)
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()]
    same(got, plain([tuple(r) for r in docs.collect()], order))


def test_query_beats_the_base_on_held_out_texts(spark):
    rows = queries.op4_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert len(rows) > 100 and rows["score"].sum() > rows["base_score"].sum()
    assert (rows["n_known"] <= rows["n_tokens"]).all() and rows["train_tokens"].nunique() == 1


@pytest.mark.parametrize("order", [2, 3, 4])
def test_every_state_sums_to_one(order):
    """The arcs of a state, and those behind its failure arcs for all other words, share out probability one."""
    train = [b"a b a c", b"b b a b a", b"", b"a b a b a c"]
    asked = Block.read([*train, b"a zz a"], order)
    used = np.array([True] * len(train) + [False])
    totals = asked.counts(used).astype(float)
    words = totals[: len(asked.hashes)]
    made = Automaton.build(asked, totals, int(words.sum()), int((words > 0).sum()), 2.0)
    arcs = dict(zip(made.arc.tolist(), made.weight.tolist(), strict=True))
    size = len(asked.hashes)

    def chance(state, w):
        if state * size + w in arcs:
            return 10 ** arcs[state * size + w]
        return 10 ** made.root[w] if state == 0 else 10 ** made.failure[state] * chance(made.back[state], w)

    # Nothing follows a longer context that closes a text, so no text leaves its state.
    last = np.concatenate([np.ones(1 + size, int), *(g.right for g in asked.grams)])
    states = {s for s in {0, *made.target.tolist(), *made.after_root.tolist()} if last[s]}
    assert len(states) > 4 * (order - 1)
    for state in states:
        assert sum(chance(state, w) for w in range(size)) == pytest.approx(1)


def test_longer_contexts_tell_more():
    rng = np.random.default_rng(5)
    texts = [" ".join("abcdef"[(k + s) % 6] if (k // 2) % 2 else "xyz"[(k * s) % 3] for k in range(30)).encode() for s in rng.integers(0, 9, 60)]
    used, scores = np.ones(len(texts), bool), []
    for order in (1, 2, 3):
        block = Block.read(texts, order)
        totals = block.counts(used).astype(float)
        words = totals[: len(block.hashes)]
        scores.append(Automaton.build(block, totals, int(words.sum()), int((words > 0).sum()), 1.0).traverse(block)[0].sum())
    assert scores[0] < scores[1] < scores[2]


def test_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (3, " \n", False), (4, "A a É é", True), (5, "never seen words", False), (None, "a a", True), (6, "a", True), (6, "a", True), (7, "a b " * 40_000, False), (8, "b", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, train boolean, block string")
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(docs).collect()]
    same(got, plain(rows))
    nothing = lm_scores(docs.withColumn("train", queries.F.lit(False))).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in nothing)
    assert lm_scores(docs.limit(0)).count() == 0


def test_packed_totals_and_buckets():
    values = np.array([0, 1, 254, 255, 256, 10**12], np.uint64)
    assert _wide(_narrow(values)).tolist() == values.tolist() and len(_wide(_narrow(values[:0]))) == 0
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 10_000, np.uint64, endpoint=False))
    bucket = _bucket(keys, 37)
    assert (np.diff(bucket) >= 0).all() and bucket.min() == 0 and bucket.max() == 36 and np.bincount(bucket).max() < 400
