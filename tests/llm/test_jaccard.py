from __future__ import annotations

import itertools
import random

import pytest
import xxhash

import corpus_pipeline
from speakable.llm.common import table
from speakable.llm.jaccard import band_keys, shingle_hashes
from speakable.llm.simhash import fingerprint, one_per_group

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return frozenset(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def survivors(rows):
    """By all pairs: in order of the hash of the words, what is not similar to an earlier one that stays."""
    kept, words = [], lambda text: b" ".join((text or "").encode().lower().split())
    for i, text in sorted(rows, key=lambda r: (xxhash.xxh3_128_digest(words(r[1])), r[0])):
        own = shingles(text)
        if all(similarity(own, other) < 0.8 for _, other in kept):
            kept.append((i, own))
    return {i for i, _ in kept}


def near_copy(rng, words, target):
    """Words replaced, far enough apart to cost five shingles each, down to about the target."""
    n = len(words) - 4
    edits = round(n * (1 - target) / (1 + target) / 5)
    out = list(words)
    for at in rng.sample(range(4, len(words) - 4, 5), edits):
        out[at] = f"edit{rng.getrandbits(40)}"
    return out


def test_stage_equals_all_pairs(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(survivors(rows))


def test_recall_of_planted_copies(spark):
    """All of 120 copies near each similarity go; fingerprints at six bits lose most of those at 0.8."""
    rng = random.Random(5)
    rows, low = [], {}
    for n, target in enumerate((0.81, 0.85, 0.9, 0.95)):
        for k in range(120):
            words = [f"w{rng.getrandbits(30)}" for _ in range(400)]
            a, b = 1000 * n + k, 100_000 + 1000 * n + k
            rows += [(a, " ".join(words)), (b, " ".join(near_copy(rng, words, target)))]
            low[b] = similarity(shingles(rows[-1][1]), shingles(rows[-2][1]))
    assert all(s >= 0.8 for s in low.values()) and min(low.values()) < 0.82
    kept = {r.doc_id for r in one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(b in kept or b - 100_000 in kept for b in low)
    for n in range(4):
        assert sum(b in kept and b - 100_000 in kept for b in low if b // 1000 == 100 + n) <= 1


@pytest.mark.parametrize(("target", "least", "most"), [(0.8, 0.995, 1), (0.5, 0, 0.6), (0.2, 0, 0.02)])
def test_bands_meet_at_the_stated_rate(target, least, most):
    rng, met = random.Random(8), 0
    for _ in range(400):
        both, each = round(200 * target), round(200 * (1 - target) / 2)
        parts = [[f"{rng.getrandbits(50)}".encode() for _ in range(n)] for n in (both, each, each)]
        a, b = (shingle_hashes(parts[0] + parts[i], 1) for i in (1, 2))
        keys = band_keys([a, b])
        met += bool((keys[0] == keys[1]).any())
    assert least <= met / 400 <= most


def test_chains_do_not_drop_what_is_far_from_the_survivor(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):  # each like the one before, the last unlike the first
        rows.append((i, " ".join(words)))
        words = near_copy(rng, words, 0.86)
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    assert all(similarity(sets[i], sets[i + 1]) >= 0.8 for i in range(11)) and similarity(sets[0], sets[11]) < 0.4
    kept = {r.doc_id for r in one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == survivors(rows) and len(kept) > 3
    assert all(similarity(sets[a], sets[b]) < 0.8 for a, b in itertools.combinations(kept, 2))


def test_texts_that_share_a_repeated_line_stay(spark):
    """Fingerprints count repeats and are nearly equal here; the shingle sets have little in common."""
    rng = random.Random(4)
    line = "this very line stands on the page again and again "
    rows = [(i, line * 100 + " ".join(f"w{rng.getrandbits(30)}" for _ in range(100))) for i in range(2)]
    a, b = (fingerprint(t.encode(), 5) for _, t in rows)
    assert (a ^ b).bit_count() <= 6 and similarity(shingles(rows[0][1]), shingles(rows[1][1])) < 0.1
    assert one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).count() == 2


def test_many_texts_of_one_band_need_few_rounds(spark):
    """Texts that share two thirds of their shingles share many bands; none is a copy."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(common + [f"w{rng.getrandbits(40)}" for _ in range(50)])) for i in range(150)]
    rows += [(1000 + i, rows[0][1] + f" end{i}") for i in range(100)]
    kept = {r.doc_id for r in one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == survivors(rows) and len(kept) == 150
