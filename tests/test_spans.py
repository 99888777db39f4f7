"""Span finding against a sequential model in another regex engine, and fixed sentences."""

from __future__ import annotations

import random

import regex
from pyspark.sql import functions as F

from speakable.functions import scanning as S
from speakable.operators import spans as O

SENTENCES = [
    ("They raised $7.1M from 2,316 donors.", "They raised seven point one million dollars from two thousand three hundred sixteen donors."),
    ("The bakery on Mill St.", "The bakery on Mill saint"),
    ("Nearly 35% of it leaked.", "Nearly thirty five percent of it leaked."),
    ("Write to www.harbour.org soon.", "Write to w w w dot harbour dot org soon."),
    ("The bridge opened in 1932.", "The bridge opened in nineteen thirty two."),
    ("King George VI dined.", "King George the sixth dined."),
    ("Chapter IX was cut.", "Chapter nine was cut."),
    ("Dr. Moss left Elm Dr.", "doctor Moss left Elm doctor"),
    ("part mix", "part one thousand nine"),
    ("Chapter XVIII", "Chapter XVIII"),
    ("  two \n blanks  ", "two blanks"),
    ("", ""),
]
TRAPS = [
    ("about 1,234.5 units", [(6, "CARDINAL_G", "1,234"), (12, "CARDINAL", "5")]),
    ("ip 114.203.152.12 end", [(3, "DECIMAL", "114.203"), (10, "DECIMAL", ".152"), (14, "DECIMAL", ".12")]),
    (".5 x", [(1, "CARDINAL", "5")]),
    ("é1 1é 5", [(6, "CARDINAL", "5")]),
    ("3:30PM", [(0, "TIME", "3:30PM")]),
    ("Chapter XVIII", []),
    ("odd ﷐ 7 ﷑ 8", [(6, "CARDINAL", "7"), (10, "CARDINAL", "8")]),
    ("😀 12 😀 13", [(2, "CARDINAL", "12"), (7, "CARDINAL", "13")]),
]
PIECES = [
    "$5.2M", "$1,234.50", "£ 3", "3:30", "PM", "p.m.", "Dr.", "St", "St.", "Main", "1,234.5", "é", "www.a.bc", "a@b.co",
    "http://x.y/z", "XIV", "Henry", "chapter", "iv", "1/2", "21st", ".5", "12", "2,000", "kg", "%", " ", " ", " ", " ",
    "\n", ",", ".", "(555)", "555-1234", "555", "-", "1984", "etc.", "i.e.", "MHz", "°C", "٣", "Ave", "!",
]


def model(text):
    """Every rule on its own, then from the left, rule order breaking ties."""
    found = []
    for prio, rule in enumerate(S.RULES):
        pattern = rule.pattern.replace("(?d)", "")
        found += [(m.start(), prio, -len(m.group()), m.group()) for m in regex.finditer(pattern, text)]
    kept, last = [], -1
    for start, prio, neg, surface in sorted(found):
        if start >= last:
            kept.append((start, S.RULES[prio].cls, surface))
            last = start - neg
    return kept


def found(df):
    rows = df.select("text", S.scan(F.col("text")).alias("s")).collect()
    return {r.text: [(x.start, x.cls, x.surface) for x in r.s] for r in rows}


def test_sentences(spark):
    df = spark.createDataFrame(SENTENCES, "text string, expected string")
    rows = O.normalized(df).collect()
    assert [r.normalized for r in rows] == [r.expected for r in rows]


def test_traps(spark):
    got = found(spark.createDataFrame([(t,) for t, _ in TRAPS], "text string"))
    assert got == dict(TRAPS)


def test_random_texts_match_model(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(1500)})
    got = found(spark.createDataFrame([(t,) for t in texts], "text string").repartition(8))
    for text in texts:
        assert got[text] == model(text), text


def test_whole_documents_match_model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = docs.select(F.explode(F.split("text", "\n")).alias("text")).filter("length(text) < 600").distinct()
    got = found(pieces.repartition(8))
    assert got and all(got[t] == model(t) for t in got)


def test_class_subset_and_counts(spark):
    df = spark.createDataFrame([(1, "Dr. 12 paid 5%"), (2, "12 12")], "id int, text string")
    assert [r.cls for r in O.spans(df, "text", "id", classes=["ABBREV"]).collect()] == ["ABBREV"]
    counts = {r.cls: r.n_spans for r in O.span_counts(O.spans(df, "text", "id")).collect()}
    assert counts == {"ABBREV": 1, "CARDINAL": 3, "MEASURE": 1}


def test_same_answer_for_any_partitioning(spark):
    base = spark.range(500).select(F.concat(F.lit("No 5, $"), F.col("id").cast("string"), F.lit(".50 at 3:05")).alias("text"))
    answers = [
        sorted(r.normalized for r in O.normalized(base.repartition(n)).collect()) for n in (1, 4, 17)
    ]
    assert answers[0] == answers[1] == answers[2]


def test_normalize_needs_no_shuffle(spark):
    df = O.normalized(spark.createDataFrame([("a 1",)], "text string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
