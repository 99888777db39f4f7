from __future__ import annotations

import random

from speakable.llm import jaccard, simhash

from .test_jaccard import survivors


def test_variants_of_one_text_are_hardly_compared(spark, monkeypatch):
    """Three words replaced in each: all are about 0.81 like the text, and 0.7 like each other."""
    rng = random.Random(21)
    base = [f"c{i}" for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(5, 145, 5), 3):
            words[at + rng.randrange(4)] = f"w{rng.getrandbits(40)}"
        rows.append((i, " ".join(words)))
    pairs, compared = [], jaccard._compared

    def seen(*args):
        found = compared(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_compared", seen)
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == survivors(rows) and len(kept) > 100
    assert sum(pairs[1:]) < len(kept) ** 2 / 2 / 4


def test_family_keys_lose_no_similar_pair(spark):
    """Variants of a few texts, some as base of others, of their own or of an unrelated text; pairs at 0.8 and more meet."""
    rng = random.Random(13)
    sets, base, pool = [], [], iter(range(1, 10**6))
    for size in (1, 2, 3, 5, 9, 20, 33, 64, 65, 110, 146):
        text, first = [next(pool) for _ in range(size)], len(sets)
        for k in range(30):
            cut = rng.sample(text, size - rng.randrange(0, size // 5 + 1))
            sets.append(sorted({*cut, *(rng.choice((next(pool), -rng.randrange(1, 40))) for _ in range(rng.randrange(0, size // 5 + 1)))}))
            base.append(rng.choice((first, first, first, max(0, first - 1), len(sets) - 1)) if k else first)
    name = lambda i: bytes([i >> 8, i & 255])
    table = spark.createDataFrame([(name(i), s) for i, s in enumerate(sets)], "unit binary, set array<long>")
    based = spark.createDataFrame([(name(i), name(b)) for i, b in enumerate(base)], "unit binary, base binary")
    has, seeks = {}, {}
    for unit, key, sought, apart in jaccard.family_keys(table, based, 0.8).collect():
        i = unit[0] << 8 | unit[1]
        assert apart is None or apart == name(base[i])
        has.setdefault(i, set()).add((key, apart is None))
        seeks.setdefault(i, set()).add((sought, apart is None))
    similar = met = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i]) & set(sets[j]))
            near = both / (len(sets[i]) + len(sets[j]) - both) >= 0.8
            ways = {inside for _, inside in has.get(i, set()) & seeks.get(j, set())}
            assert ways == {inside for _, inside in has.get(j, set()) & seeks.get(i, set())}
            meet = (base[i] == base[j]) in ways
            assert meet or not near
            similar, met = similar + near, met + meet
    assert similar > 300 and met < 0.2 * len(sets) ** 2 / 2


def made_by_generators(spark, since):
    """Rows made by each generator of the executions after ``since``."""
    store, made = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for run in [runs.apply(i).executionId() for i in range(runs.size())]:
        if run > since:
            values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if node.name() == "Generate":
                    metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                    made += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return made


def test_classes_of_partners_are_not_listed(spark):
    """Units that share most of their shingles across families and have few partners: no step makes more rows than sets have elements."""
    rng = random.Random(14)
    text, pool = list(range(1, 401)), iter(range(1000, 10**6))
    sets = [sorted(rng.sample(text, 340) + [next(pool) for _ in range(40)]) for _ in range(60)]
    table = spark.createDataFrame([(bytes([i]), s) for i, s in enumerate(sets)], "unit binary, set array<long>")
    based = spark.createDataFrame([(bytes([i]), bytes([i % 2])) for i in range(len(sets))], "unit binary, base binary")
    store = spark._jsparkSession.sharedState().statusStore()
    since = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1)
    jaccard.family_keys(table, based, 0.8).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    elements = sum(len(s) + max(1, len(set(s) ^ set(sets[i % 2]))) for i, s in enumerate(sets))
    made = made_by_generators(spark, since)
    assert made and max(made) <= elements
