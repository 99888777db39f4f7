from __future__ import annotations

import random

from speakable.llm import jaccard, simhash
from speakable.llm.jaccard import majority, shingle_hashes

from .test_jaccard import near_copy, survivors


def test_fingerprints_name_candidates(spark, monkeypatch):
    """The step goes through the fingerprint index; an exact check of all shingles follows."""
    rng = random.Random(9)
    words = [[f"w{rng.getrandbits(30)}" for _ in range(400)] for _ in range(20)]
    rows = [(k, " ".join(w)) for k, w in enumerate(words)] + [(100 + k, " ".join(near_copy(rng, w, 0.97))) for k, w in enumerate(words)]
    asked, links = [], simhash.links

    def seen(prints, distance, *more):
        asked.append(distance)
        return links(prints, distance, *more)

    monkeypatch.setattr(simhash, "links", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in simhash.one_per_group(docs).collect()} == survivors(rows)
    assert asked == [6]


def test_fingerprint_of_the_sketch_is_that_of_the_operator():
    rng = random.Random(2)
    for n in (1, 3, 5, 40, 300):
        words = [f"w{rng.getrandbits(30)}".encode() for _ in range(n)]
        assert majority(shingle_hashes(words, 5)) == simhash.fingerprint(b" ".join(words), 5)


def test_rarest_keys_lose_no_similar_pair(spark):
    """Sets of many sizes around a few bases; pairs at 0.8 and more meet, most of the others do not."""
    rng = random.Random(12)
    sets, pool = [], iter(range(1, 10**6))
    for size in (1, 2, 3, 5, 8, 20, 40, 41, 57, 100, 146):
        base = [next(pool) for _ in range(size)]
        for _ in range(30):
            cut = rng.sample(base, size - rng.randrange(0, size // 4 + 1))
            sets.append(cut + [rng.choice((next(pool), -rng.randrange(1, 40))) for _ in range(rng.randrange(0, size // 5 + 1))])
    sets = [sorted(set(s)) for s in sets]
    table = spark.createDataFrame([(bytes([i >> 8, i & 255]), s) for i, s in enumerate(sets)], "unit binary, set array<long>")
    has, seeks = {}, {}
    for unit, key, sought in jaccard.rarest_keys(table, 0.8).collect():
        i = unit[0] << 8 | unit[1]
        has.setdefault(i, set()).add(key)
        seeks.setdefault(i, set()).add(sought)
    similar = met = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            near = both / (len(sets[i]) + len(sets[j]) - both) >= 0.8
            meet = bool(has.get(i, set()) & seeks.get(j, set()))
            assert meet == bool(has.get(j, set()) & seeks.get(i, set()))
            assert meet or not near
            similar, met = similar + near, met + meet
    assert similar > 300 and met < 0.2 * len(sets) ** 2 / 2


def test_resembling_texts_are_not_all_compared(spark, monkeypatch):
    """Texts that share two thirds of their shingles share bands, but only few of their pairs are compared."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(common + [f"w{rng.getrandbits(40)}" for _ in range(50)])) for i in range(150)]
    pairs, compared = [], jaccard._compared

    def seen(*args):
        found = compared(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_compared", seen)
    assert simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).count() == 150
    assert 0 < sum(pairs) < 150 * 149 / 2 / 3
