"""Quality rules on repetition: suffix array and common-prefix intervals per text.

A text is a sequence of words. Its suffix array is built by prefix doubling,
for many texts at once: every suffix starts in a group of its own text, and
only groups that are still unresolved are sorted again. The ranks of all
doublings then give the common prefix of neighbours, the longest repeat that
starts at each word is the larger of the two neighbouring prefixes, and the
starts that cannot be extended to the left are the maximal repeats. Their
spans are united; a text is dropped when the covered share of its words or
its longest repeat exceeds a limit.

Defined cases: a null or empty text has no words and fails the length rule;
texts of any length are taken whole; equal rows get equal results; an empty
table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, steps

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "longest_repeat long, covered_words long, covered_share double, kept boolean"
)


def suffix_repeats(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per word, the length of the longest repeat in its own text that starts there.

    ``words`` holds the word numbers of many texts in a row and ``starts`` the
    first position of each text, with the total length at the end.
    """
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n == 0:
        return longest
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[1:][text_of]
    key = text_of.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _group_numbers(key[order])
    ranks, width = [rank], 1
    active = order
    while True:
        groups = rank[active]
        alone = np.ones(len(active), bool)
        if len(active) > 1:
            same = groups[1:] == groups[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
        active = active[~alone]
        if not len(active):
            break
        nxt = active + width
        inside = nxt < end[active]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
        groups = rank[active]
        # Groups of equal rank lie together; within each, sort by the rank of the following half.
        by = np.lexsort((second, groups))
        active, groups, second = active[by], groups[by], second[by]
        new = np.empty(len(active), bool)
        new[0] = True
        new[1:] = (groups[1:] != groups[:-1]) | (second[1:] != second[:-1])
        # A suffix that ends here is shorter than the width compared, so it stands alone.
        new |= second == 0
        new[1:] |= second[:-1] == 0
        first = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        head = np.maximum.accumulate(np.where(np.r_[True, groups[1:] != groups[:-1]], np.arange(len(active)), 0))
        rank = rank.copy()
        rank[active] = groups + (first - head)
        ranks.append(rank)
        width *= 2
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    left, right = place[:-1], place[1:]
    pair = np.flatnonzero(ranks[0][left] == ranks[0][right])
    common = np.zeros(max(n - 1, 0), np.int64)
    a, b = left[pair].copy(), right[pair].copy()
    got = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        ok = (a < end[left[pair]]) & (b < end[right[pair]])
        same = ok & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        step = same * (1 << level)
        got += step
        a += step
        b += step
    common[pair] = got
    longest[right] = common
    np.maximum.at(longest, left, common)
    return longest


def _group_numbers(ordered: np.ndarray) -> np.ndarray:
    """For sorted keys, the position of the first equal one."""
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def maximal_spans(longest: np.ndarray, least: int) -> np.ndarray:
    """Starts of repeats of at least ``least`` words that no repeat one word earlier contains."""
    before = np.r_[0, longest[:-1]]
    return np.flatnonzero((longest >= least) & (before < longest + 1))


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[starts[1:]] - total[starts[:-1]]


def _dup_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def repetition_rules(
    text: Column,
    min_repeat_words: int = 5,
    max_covered_share: float = 0.25,
    max_longest_words: int = 60,
    min_words: int = 20,
    max_window_percent: int = 30,
) -> Column:
    """Counts, repeats and verdict of a text, as a struct of ``FIELDS``."""

    @F.pandas_udf(FIELDS)
    def rules(texts: pd.Series) -> pd.DataFrame:
        out = []
        for _, run in steps(texts):
            known: dict[bytes, int] = {}
            ids, counts = [], []
            for data in run:
                words = data.split()
                counts.append(len(words))
                ids.extend([known.setdefault(w, len(known)) for w in words])
            starts = np.r_[0, np.cumsum(counts)].astype(np.int64)
            longest = suffix_repeats(np.array(ids, np.int64), starts)
            n = len(longest)
            begin = maximal_spans(longest, min_repeat_words)
            in_repeat = covered(begin, longest[begin], n)
            window = np.flatnonzero(longest >= WINDOW)
            in_window = covered(window, np.full(len(window), WINDOW), n)
            top = np.zeros(len(run), np.int64)
            full = np.flatnonzero(np.diff(starts))
            if n:
                top[full] = np.maximum.reduceat(longest, starts[:-1][full])
            n_words = np.array(counts, np.int64)
            n_covered, n_window = _sums(in_repeat, starts), _sums(in_window, starts)
            chars = [len(d) - _continuations(d) - (len(d) - len(d.translate(None, SPACE))) for d in run]
            failed = (n_words < min_words) | (100 * n_window > max_window_percent * n_words)
            share = n_covered / np.maximum(n_words, 1)
            out.append(
                pd.DataFrame(
                    {
                        "n_words": n_words,
                        "word_chars": np.array(chars, np.int64),
                        "n_symbols": np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in run], np.int64),
                        "n_dup_lines": np.array([_dup_lines(d) for d in run], np.int64),
                        "n_repeat_words": n_window,
                        "base_failed": failed,
                        "longest_repeat": top,
                        "covered_words": n_covered,
                        "covered_share": share,
                        "kept": ~failed & (share <= max_covered_share) & (top <= max_longest_words),
                    }
                )
            )
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in FIELDS.split(", ")})

    return rules(text)


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(data: bytes) -> int:
    return len(data) - len(data.translate(None, _CONTINUATION))


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document with the counts and the verdict."""
    rules = repetition_rules(F.col("text"), **limits)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", rules.alias("r")).select("doc_id", "r.*")
