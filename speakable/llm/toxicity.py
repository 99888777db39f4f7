"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters, one for each word or word
beginning that a bounded labelled sample marks as suspicious, and
pattern voters for shouting, insistence, symbols and mention of
others. Each votes toxic or abstains; what a text does not say speaks for it. A generative model with a hidden
label finds voters that fire together more often than the label explains, makes
them a family with one vote, so that related words do not count many times, and
estimates by expectation-maximisation how often each fires under either label. The posterior of the hidden label is
the target of a logistic classifier over the same evidence, which then scores
every text.

Bounds of the fit: ``sample_rows`` labelled ids per label, one text for each however often it
repeats, and ``lexicon`` voters; only their votes and counts reach the driver.

Defined cases: null and empty texts get the score of a text without evidence;
texts of any length are read whole; equal texts get equal scores; without
labelled rows of both kinds every score is the prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_text_each, sample_ids

EDGE = b".,;:!?\"'()[]{}|#*$%&<>-_=+~/\\"
HEADS = (4, 5, 6, 7, 8)
PATTERNS = ("shouting", "insistence", "symbols", "second_person")
SECOND_PERSON = {b"you", b"your", b"you're"}


def evidence(data: bytes) -> set[bytes]:
    """Distinct words of a text and their beginnings.

    A beginning ends in one star where one word has it, and once more in two
    and three stars where two or four different words have it.
    """
    found = {w.strip(EDGE) for w in set(data.lower().split())}
    found.discard(b"")
    heads = Counter(w[:n] for n in HEADS for w in found if len(w) > n)
    found.update(h + b"*" for h in heads)
    found.update(h + b"**" for h, n in heads.items() if n > 1)
    found.update(h + b"***" for h, n in heads.items() if n > 3)
    return found


def pattern_votes(data: bytes) -> list[bool]:
    words = data.split()
    n = max(len(words), 1)
    return [
        sum(w.isupper() and len(w) > 2 for w in words) * 10 > n,
        data.count(b"!!") * 50 > n,
        len(data) - len(data.translate(None, b"#*$%&|<>")) > n // 2,
        sum(w.lower() in SECOND_PERSON for w in words) * 20 > n,
    ]


@dataclass
class LabelModel:
    """How often each voter fires under either hidden label, and the families of correlated voters."""

    prior: float
    fires: np.ndarray  # 2 x voters: row 0 clean, row 1 toxic
    family: np.ndarray  # family number of each voter
    silent: np.ndarray  # 2 x families: how often no member fires

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A family says what its strongest member says that fires, or counts as silent."""
        says = np.log(self.fires[1]) - np.log(self.fires[0])
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for k in range(self.silent.shape[1]):
            own = self.family == k
            loudest = np.where(votes[:, own] > 0, says[own], -np.inf).max(axis=1)
            logit += np.where(np.isfinite(loudest), loudest, np.log(self.silent[1, k] / self.silent[0, k]))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _rates(
    q: np.ndarray, events: np.ndarray, rows: np.ndarray, first: np.ndarray | float = 0.0, weight: np.ndarray | float = 0.0
) -> np.ndarray:
    """Share of events under either label; texts count as ``rows``, first rates as ``weight`` texts."""
    fine, bad = (1 - q) * rows, q * rows
    mass = np.array([fine.sum(), bad.sum()])[:, None]
    return np.clip((np.vstack([fine @ events, bad @ events]) + weight * first + 0.25) / (mass + weight + 0.5), 1e-5, 1 - 1e-5)


def fit_label_model(
    votes: np.ndarray,
    guess: np.ndarray,
    prior: float,
    strength: float = 1.0,
    rounds: int = 40,
    linked: float = 0.25,
    rows: np.ndarray | None = None,
) -> LabelModel:
    """Families first, then EM over the hidden label.

    ``guess`` (2 x voters) holds first rates of firing under either label. Voters
    that fire together more often than these rates explain form a family. The
    guess counts as ``strength`` times the texts, which keeps the hidden label
    from turning into "many votes" against "few". ``rows`` says how many texts each
    one stands for.
    """
    rows = np.ones(len(votes)) if rows is None else rows
    votes, guess = votes.astype(float), np.clip(guess, 1e-5, 1 - 1e-5)
    weight = strength * len(votes) * np.array([1 - prior, prior])[:, None]
    family = families(votes, guess, prior, linked, rows)
    quiet = np.column_stack([(votes[:, family == k] == 0).all(axis=1) for k in range(family.max(initial=-1) + 1)]).astype(float)
    silent = np.vstack([[(1 - guess[y, family == k]).min() for k in range(quiet.shape[1])] for y in (0, 1)])
    model = LabelModel(prior, guess, family, silent)
    q = model.posterior(votes)
    for _ in range(rounds):
        model = LabelModel(prior, _rates(q, votes, rows, guess, weight), family, _rates(q, quiet, rows))
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


def families(votes: np.ndarray, rates: np.ndarray, prior: float, linked: float, rows: np.ndarray) -> np.ndarray:
    """Number voters so that those correlated beyond the hidden label share a number.

    Only voters that lean the same way can be one family.
    """
    share = np.array([1 - prior, prior])
    heavy = votes * rows[:, None] / max(rows.sum(), 1)
    together = votes.T @ heavy - (rates * share[:, None]).T @ rates
    mean = heavy.sum(axis=0)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    leans = rates[1] > rates[0]
    near = (together / np.outer(spread, spread) > linked) & (leans[:, None] == leans[None, :])
    number = np.arange(votes.shape[1])
    while True:
        new = np.array([min(number[j], number[near[j]].min(initial=number[j])) for j in range(len(number))])
        if (new == number).all():
            return np.unique(number, return_inverse=True)[1]
        number = new


@dataclass
class ToxicityModel:
    lexicon: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = -2.0
    label_model: LabelModel | None = None

    def votes(self, texts: Iterable[str | None]) -> np.ndarray:
        place = {w: i for i, w in enumerate(self.lexicon)}
        k = len(place)
        out = np.zeros((len(texts), k + len(PATTERNS)), bool)
        for i, text in enumerate(texts):
            data = text.encode() if isinstance(text, str) else b""
            for w in place.keys() & evidence(data):
                out[i, place[w]] = True
            out[i, k:] = pattern_votes(data)
        return out

    def score(self, texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), 256):
            v = self.votes(texts.iloc[i : i + 256]) @ self.weights if len(self.weights) else 0.0
            out[i : i + 256] = 1 / (1 + np.exp(-np.clip(self.offset + v, -40, 40)))
        return pd.Series(out)


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 60, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps; texts count as ``rows``."""
    rows = np.ones(len(x)) if rows is None else rows
    z = np.c_[np.ones(len(x)), x.astype(float)]
    beta = np.zeros(z.shape[1])
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        grad = z.T @ (rows * (target - p)) - penalty * beta
        hess = (z * (rows * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    return beta[1:], float(beta[0])


def train_toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    sample_rows: int = 3000,
    lexicon: int = 400,
    min_odds: float = 4.0,
    min_gain: float = 16.0,
) -> ToxicityModel:
    """Choose voters from a bounded labelled sample, fit the label model, train the classifier.

    ``labelled`` has doc_id and label (1 toxic) for the rows that may be
    learned from.
    """
    labelled = labelled.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    picked = sample_ids(labelled.filter("label = 0"), "doc_id", sample_rows).unionByName(
        sample_ids(labelled.filter("label = 1"), "doc_id", sample_rows)
    )
    # At most 2 * sample_rows ids: a proven bound for the broadcast.
    rows = one_text_each(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "doc_id", "label").persist()

    @F.pandas_udf("array<binary>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(evidence(t.encode())) if isinstance(t, str) else [])

    try:
        n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(n) < 2:
            return ToxicityModel(offset=-2.0)
        # The sample may hold the labels in another ratio than the table: each text stands for its share of all labelled rows.
        all_ = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
        prior = all_[1] / (all_[0] + all_[1])
        stands = {y: share * (n[0] + n[1]) / n[y] for y, share in ((0, 1 - prior), (1, prior))}
        rate = lambda hits, all_: (F.col(hits) + 0.5) / (all_ + 1.0)
        part = lambda hits, all_: F.col(hits) * F.log((F.col(hits) + 1e-9) * (n[0] + n[1]) / (all_ * (F.col("bad") + F.col("fine"))))
        # Gain: how many nats better the two counts are told apart than by chance; it rules out accidents among many words.
        found = (
            rows.select("label", F.explode(words("text")).alias("w"))
            .groupBy("w")
            .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("fine"))
            .withColumn("gain", part("bad", n[1]) + part("fine", n[0]))
            .filter((F.col("gain") >= min_gain) & (rate("bad", n[1]) / rate("fine", n[0]) >= min_odds))
            .orderBy(F.col("gain").desc(), "w")
            .limit(lexicon)
        )
        hits = found.collect()
        chosen: dict[bytes, tuple[int, int]] = {}
        stems: list[tuple[bytes, int]] = []
        for r in hits:  # the best first: one voter for a word and its beginnings, and one for each number of stars
            w, stem, stars = bytes(r.w), bytes(r.w).rstrip(b"*"), max(bytes(r.w).count(b"*"), 1)
            if not any(s == stars and (stem.startswith(c) or c.startswith(stem)) for c, s in stems):
                chosen[w] = (r.bad, r.fine)
                stems.append((stem, stars))
        model = ToxicityModel(list(chosen))
        look = F.pandas_udf(lambda texts: pd.Series(list(np.packbits(model.votes(texts), axis=1))).map(bytes), "binary")
        seen = rows.select("label", look("text").alias("v")).collect()
        width = len(model.lexicon) + len(PATTERNS)
        votes = np.array([np.unpackbits(np.frombuffer(bytes(r.v), np.uint8))[:width] for r in seen], bool)
        bad, fine = (np.array([c[i] for c in chosen.values()], float) for i in (0, 1))
        # Pattern voters carry no labels: they start as uninformative and learn from the others.
        some = np.clip(np.average(votes[:, len(chosen) :], axis=0, weights=[stands[r.label] for r in seen]), 1e-3, 0.5)
        guess = np.vstack([np.r_[(fine + 0.1) / (n[0] + 0.2), some], np.r_[(bad + 0.1) / (n[1] + 0.2), some]])
        rows_each = np.array([stands[r.label] for r in seen])
        model.label_model = fit_label_model(votes, guess, prior, rows=rows_each)
        target = model.label_model.posterior(votes.astype(float))
        model.weights, model.offset = fit_linear(votes, target, rows=rows_each)
    finally:
        rows.unpersist()
    return model


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    return F.pandas_udf(model.score, "double")(text)
