from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from speakable.llm.decontam import NAME, NUM, NUMBER_WORDS, UNIT, UNITS, leaked, without_contaminated

PEOPLE = "Sarah has 12 apples. Tom has 5. Mary takes three pears and walks home. Sarah counts the rest. How many does Tom keep at last?"
SHOUT = "When Anna sells 12 apples to Robert and keeps 5 apples, how many apples had Anna before noon today?"
TABLE = "Paris 2148 Lyon 516 Nice 342 Lille 236 Nantes 323 Rennes 222"
FILL = "unrelated words stand here before anything else happens in this plain story of ours"


@pytest.fixture(scope="module")
def long_item():
    rng = random.Random(2)
    return " ".join(f"{rng.choice('bdfgkl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.randrange(900)}x" for _ in range(400))


def plain_forms(text, vocabulary):
    """(template, value, template by value, capital) per token."""
    joined = re.sub("([0-9])[.,]([0-9])", r"\1\2", text)
    words = [w for w in re.split(r"[^\w\x01]+|_", re.sub("[.!?:]+", " \x01 ", joined)) if w]
    out, before, value = [], "\x01", None
    for w in words:
        low, digit = w.lower(), lambda x: x is not None and "0" <= x[:1] <= "9"
        number = lambda x: x is not None and (digit(x) or x in NUMBER_WORDS)
        if w != "\x01":
            t = NUM if digit(w) else UNIT if digit(before) and low in UNITS else NAME if before != "\x01" and w[0] != low[0] else low
            o = NUM if number(low) else UNIT if number(value) and low in UNITS else low if low in vocabulary else NAME
            out.append((t, low, o, w[0] != low[0]))
            value = low
        before = w
    return out


def plain_leaks(docs, items):
    """docs and items: (id, text). Ids of the documents that ``leaked`` finds."""
    split = lambda t: re.split(r"[^\w\x01]+|_", re.sub("[.!?:]+", " \x01 ", re.sub("([0-9])[.,]([0-9])", r"\1\2", t)))
    vocabulary = {w for _, t in items if t for w in split(t) if w and w != "\x01" and w[0] == w[0].lower()}
    vocabulary = {w.lower() for w in vocabulary}
    slot = (NUM, NAME, UNIT)
    literals = lambda c, k: sum(x[k] not in slot for x in c)
    pattern = lambda c, k: [[(y[k], y[1]) for y in c].index((x[k], x[1])) + 1 if x[k] in slot else 0 for x in c]

    def same(c, d, least):
        by = lambda k: [x[k] for x in c] == [x[k] for x in d] and literals(c, k) >= least and pattern(c, k) == pattern(d, k)
        return [x[1] for x in c] == [x[1] for x in d] or by(0) or (by(2) and all(x[2] != NAME or x[3] for x in d))

    keys = lambda c: {tuple(x[0] for x in c), tuple(x[2] for x in c)}
    marks, totals = defaultdict(list), {}
    for item, text in items:
        c = plain_forms(text or "", vocabulary)
        if len(c) < 5:
            continue
        size = min(8, len(c))
        rich = [literals(c[i : i + size], 0) >= 4 for i in range(len(c) - size + 1)]
        totals[item] = (len(rich), sum(rich))
        for i, r in enumerate(rich):
            for key in keys(c[i : i + size]):
                marks[key].append((item, i, r, c[i : i + size], c[i : i + 13]))
    sizes, bad = {len(k) for k in marks}, set()
    for doc, text in docs:
        d, hits = plain_forms(text or "", vocabulary), {}
        for size in sizes:
            for i in range(len(d) - size + 1):
                for item, at, r, c, long in {(m[0], m[1]): m for key in keys(d[i : i + size]) for m in marks.get(key, ())}.values():
                    passage = len(long) == 13 == len(d[i : i + 13]) and same(long, d[i : i + 13], 7)
                    if passage or same(c, d[i : i + size], 4):
                        hits[item, at] = (r, passage or hits.get((item, at), (r, False))[1])
        for item, (n, n_rich) in totals.items():
            mine = [v for (k, _), v in hits.items() if k == item]
            rich = sum(r for r, _ in mine)
            if mine and (len(mine) >= 0.25 * n or (rich and rich >= 0.25 * n_rich) or any(p for _, p in mine)):
                bad.add(doc)
    return bad


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bad = {r.doc_id for r in leaked(docs, bench).collect()}
    assert bad == {r.doc_id for r in leaked(docs, bench, broadcast_rows=0).collect()}
    assert bad == plain_leaks(list(enumerate(texts)), list(enumerate(items)))
    assert {r.doc_id for r in without_contaminated(docs, bench).collect()} == set(range(len(texts))) - bad
    return bad


def test_other_names_casing_and_marks(spark):
    renamed = PEOPLE.replace("Sarah", "Judith").replace("Tom", "Ferdinand").replace("Mary", "Olga").replace("12", "31").replace("three", "nine")
    bare = PEOPLE.replace(".", "").replace("?", "")
    texts = [renamed, SHOUT.upper(), SHOUT.lower(), bare, f"{FILL} {renamed.replace('.', '')}", FILL, None, "", FILL.upper(), FILL.title()]
    assert found(spark, texts, [PEOPLE, SHOUT]) == {0, 1, 2, 3, 4}


def test_passage_of_a_long_item_and_items_of_few_literals(spark, long_item):
    words = long_item.split()
    texts = [f"{FILL} {' '.join(words[100:160])} {FILL}", f"{FILL} {' '.join(words[100:112])} {FILL}", f"{FILL} {TABLE}", f"Oslo 7 Bergen 9 Moss 1 Hamar 4 Tromso 8 Bodo 3 {FILL}"]
    assert found(spark, texts, [long_item, TABLE]) == {0, 2}


def test_slots_of_a_passage_map_one_to_one(spark):
    item = "so Anna gave Bob more coins than Anna gave Bob stamps or stones " + FILL.replace("e", "i") * 4
    good = "so Eve gave Joe more coins than Eve gave Joe stamps or stones"
    bad = "so Eve gave Joe more coins than Joe gave Eve stamps or stones"
    assert found(spark, [good, bad], [item]) == {0}


def test_nothing_to_meet(spark):
    docs = spark.createDataFrame([(1, FILL), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert leaked(docs, bench).count() == 0 and leaked(docs, bench.filter(F.lit(False))).count() == 0
