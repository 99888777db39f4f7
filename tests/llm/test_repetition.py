from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speakable.llm.repetition import covered, maximal_spans, repetition_report, suffix_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_by_pairs(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=20), min_size=1, max_size=4))
def test_repeats_equal_brute_force(texts):
    starts = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    got = suffix_repeats(np.array(sum(texts, []), np.int64), starts)
    assert got.tolist() == sum((longest_by_pairs(t) for t in texts), [])


def test_maximal_spans_cover_what_all_repeats_cover():
    words = [0, 1, 2, 3, 9, 0, 1, 2, 3, 8, 1, 2, 3]
    longest = suffix_repeats(np.array(words), np.array([0, len(words)]))
    every = np.flatnonzero(longest >= 3)
    some = maximal_spans(longest, 3)
    assert set(some) < set(every)
    assert (covered(some, longest[some], 13) == covered(every, longest[every], 13)).all()


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    longest = longest_by_pairs(words)
    in_window = set()
    for i, k in enumerate(longest):
        if k >= 8:
            in_window |= set(range(i, i + 8))
    span = set()
    for i, k in enumerate(longest):
        if k >= 5:
            span |= set(range(i, i + k))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(in_window) > 30 * len(words)
    share = len(span) / max(len(words), 1)
    top = max(longest, default=0)
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
        len(in_window), failed, not failed and share <= 0.25 and top <= 60,
    )


def test_report_equals_brute_force(spark):
    run = " ".join(f"w{i}" for i in range(70))
    fresh = " ".join(f"u{i}" for i in range(600))
    texts = [
        None, "", "   \n\t ", "one", "a b " * 30, fresh, f"{run} {fresh} {run}", "x\nx\n\ny |<> $%\nx", "é ü ß 中 " * 9,
        "same line here\n" * 4 + fresh, fresh, " ".join(f"v{i}" for i in range(200)) + " é",
    ]
    rows = [(i, t, "kept", 7) for i, t in enumerate(texts)] + [(None, "no id", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = {r.doc_id: r for r in repetition_report(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == expected(t), t
    assert got[5].kept and not got[4].kept and not got[6].kept


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    row = repetition_report(docs).first()
    assert row.n_words == 200_000 and row.longest_repeat == 195_000 and row.base_failed
    assert repetition_report(docs.filter(F.lit(False))).count() == 0
