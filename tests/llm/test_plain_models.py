"""Scores of both classifiers recomputed in plain Python from the fitted models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from speakable.llm.common import one_text_each
from speakable.llm.quality import LEVEL, train_quality
from speakable.llm.toxicity import LabelModel, _rates, families, train_toxicity

GOOD = "the quiet harbour town kept its ledgers in careful order and every entry was read aloud twice "
BAD = "CLICK here now!!! buy $$$ cheap ### offer %%% win win win "


def corpus(spark, n=240):
    rows = [(k, f"{BAD if k % 3 == 0 else GOOD}{k} " * (2 + k % 7), int(k % 3 != 0), int(k % 3 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def sizes(dictionary, data, step):
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
    return sum(len(packer.compress(data[i : i + step])) for i in range(0, len(data), step))


def test_quality_scores(spark):
    docs = corpus(spark)
    model = train_quality(docs, docs.select("doc_id", F.col("quality").alias("label")))
    texts = [GOOD * 3, BAD * 4, "", None, "half " + GOOD + BAD, "é" * 9000]
    half = float(model.evidence(pd.Series(["x" * 1000]))["w"].iloc[0])
    half_bytes = 1000 / half - 1000
    for text, got in zip(texts, model.score(pd.Series(texts, dtype=object)), strict=True):
        data = (text or "").encode()
        x = w = 0.0
        if data:
            x = (sizes(model.bad, data, model.block_bytes) - sizes(model.good, data, model.block_bytes)) / len(data)
            w = len(data) / (len(data) + half_bytes)
        assert math.isclose(got, 1 / (1 + math.exp(-(model.prior + w * (model.offset + model.slope * x)))), rel_tol=1e-6)
    scores = model.score(pd.Series(texts[:2]))
    assert scores[0] > 0.8 > 0.2 > scores[1]


def plain_evidence(text):
    edge = ".,;:!?\"'()[]{}|#*$%&<>-_=+~/\\"
    words = {w.strip(edge) for w in text.lower().split()} - {""}
    found = set(words)
    for n in (4, 5, 6, 7, 8):
        for head in {w[:n] for w in words if len(w) > n}:
            many = sum(w[:n] == head and len(w) > n for w in words)
            found |= {head + "*" * stars for stars, least in ((1, 1), (2, 2), (3, 4)) if many >= least}
    return found


def test_toxicity_scores(spark):
    docs = corpus(spark)
    model = train_toxicity(docs, docs.select("doc_id", F.col("toxic").alias("label")), min_gain=4.0)
    assert model.lexicon
    texts = [GOOD * 3, BAD * 4, "", None, "offers and offerings of an offer", "you YOUR you're WIN"]
    for text, got in zip(texts, model.score(pd.Series(texts, dtype=object)), strict=True):
        text = text or ""
        words = text.split()
        n = max(len(words), 1)
        votes = [w.decode() in plain_evidence(text) for w in model.lexicon] + [
            sum(w.isupper() and len(w) > 2 for w in words) * 10 > n,
            text.count("!!") * 50 > n,
            sum(c in "#*$%&|<>" for c in text) > n // 2,
            sum(w.lower() in ("you", "your", "you're") for w in words) * 20 > n,
        ]
        z = model.offset + sum(float(w) for w, v in zip(model.weights, votes, strict=True) if v)
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_families_and_one_step_of_the_label_model():
    rng = np.random.default_rng(3)
    label = rng.random(600) < 0.3
    one = np.where(label, rng.random(600) < 0.8, rng.random(600) < 0.02)
    votes = np.column_stack([one, one ^ (rng.random(600) < 0.02), np.where(label, rng.random(600) < 0.5, rng.random(600) < 0.05)]).astype(float)
    guess = np.array([[0.02, 0.04, 0.05], [0.8, 0.78, 0.5]])
    rows = np.ones(600)
    number = families(votes, guess, 0.3, 0.25, rows)
    assert number[0] == number[1] != number[2]
    quiet = np.column_stack([(votes[:, number == k] == 0).all(axis=1) for k in range(2)]).astype(float)
    silent = np.vstack([[(1 - guess[y, number == k]).min() for k in range(2)] for y in (0, 1)])
    model = LabelModel(0.3, guess, number, silent)
    q = model.posterior(votes)
    for i in range(40):  # one vote a family: that of its loudest member
        logit = math.log(0.3 / 0.7)
        for k in range(2):
            fired = [math.log(guess[1, j] / guess[0, j]) for j in range(3) if number[j] == k and votes[i, j]]
            logit += max(fired) if fired else math.log(silent[1, k] / silent[0, k])
        assert math.isclose(q[i], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
    rates = _rates(q, votes, rows)
    want = (sum(q[i] * votes[i, 0] for i in range(600)) + 0.25) / (sum(q) + 0.5)
    assert math.isclose(rates[1, 0], want, rel_tol=1e-9) and quiet.shape == (600, 2)


def test_an_id_that_repeats_counts_once_in_a_sample(spark):
    docs = corpus(spark)
    many = docs.unionByName(docs.filter("doc_id = 3").select(F.col("doc_id"), F.explode(F.array_repeat("text", 2000)).alias("text"), "quality", "toxic"))
    assert one_text_each(many, "doc_id").count() == 240
    labels = docs.select("doc_id", F.col("toxic").alias("label"))
    once, often = (train_toxicity(d, labels, min_gain=4.0) for d in (docs, many))
    assert once.lexicon == often.lexicon and np.allclose(once.weights, often.weights)
