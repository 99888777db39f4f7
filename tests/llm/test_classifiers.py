from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speakable.llm import queries
from speakable.llm.quality import quality_score, train_quality
from speakable.llm.toxicity import evidence, fit_label_model, toxicity_score, train_toxicity

ODD = [None, "", " \n", "Word", "x" * 300_000, "Word"]


@pytest.mark.parametrize(
    ("name", "column", "limit", "least"), [("op2_quality", "quality", 0.7, 0.88), ("op9_toxicity", "toxic", 0.5, 0.92)]
)
def test_held_out_accuracy(spark, name, column, limit, least):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").toPandas()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= limit) == (rows["predicted"] == 1)).all()
    held = rows[rows["held_out"]]
    assert len(held) > 50
    assert (held["predicted"] == held[column]).mean() >= least
    assert out.dtypes[1:] == [("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def test_labels_of_held_out_rows_are_not_read(spark, tmp_path):
    """Turning every held-out label around changes no score."""
    docs = spark.createDataFrame([(i, f"good plain text number {i} " * 5 if i % 2 else f"## $$ junk {i} ** %%" * 5) for i in range(80)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for kind in ("a", "b"):
        sf = f"{tmp_path}/{kind}"
        flip = (queries.fold(F.col("doc_id"), 4) == 2) & F.lit(kind == "b")
        label = (F.col("doc_id") % 2).cast("int")
        docs.select("doc_id", F.when(flip, 1 - label).otherwise(label).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{sf}/labels.parquet")
        docs.write.parquet(f"{sf}/documents.parquet")
    a, b = ({r.doc_id: r.score for r in queries.op2_quality(spark, f"{tmp_path}/{k}").collect()} for k in ("a", "b"))
    assert a == b and all((a[i] > 0.5) == bool(i % 2) for i in a)


def test_odd_texts_and_missing_labels(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "x")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, label int")
    quality, toxic = train_quality(docs, none), train_toxicity(docs, none)
    rows = docs.select("doc_id", "label", quality_score(quality, F.col("text")).alias("q"), toxicity_score(toxic, F.col("text")).alias("t")).collect()
    assert len(rows) == 7 and all(r.q == 0.5 and 0 <= r.t < 0.5 for r in rows)
    some = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (4, None), (None, 1), (0, 1)], "doc_id long, label int")
    for train, score in ((train_quality, quality_score), (train_toxicity, toxicity_score)):
        got = docs.select("doc_id", score(train(docs, some), F.col("text")).alias("s")).orderBy("doc_id").collect()
        by = {r.doc_id: r.s for r in got}
        assert by[0] == by[1] and by[3] == by[5] and all(0 <= s <= 1 for s in by.values())
        assert score(train(docs.limit(0), some), F.col("text")) is not None


def test_label_model_finds_rates_and_families():
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.3
    fire = lambda bad, fine: rng.random(6000) < np.where(y, bad, fine)
    a, b, c = fire(0.6, 0.1), fire(0.7, 0.05), fire(0.1, 0.6)
    votes = np.column_stack([a, b, c, np.where(rng.random(6000) < 0.95, a, ~a)])
    guess = np.array([[0.05, 0.1, 0.5, 0.08], [0.7, 0.6, 0.2, 0.7]])
    model = fit_label_model(votes, guess, 0.3, strength=1.0)
    assert model.family[0] == model.family[3] != model.family[2]
    assert abs(model.fires[1][1] - 0.7) < 0.15 and abs(model.fires[0][2] - 0.6) < 0.15
    assert ((model.posterior(votes.astype(float)) > 0.5) == y).mean() > 0.87


def test_evidence_counts_beginnings():
    got = evidence("Badword badworse, BADNESS fine".encode())
    assert {b"badword", b"badw*", b"badw**", b"fine"} <= got and b"badn**" not in got and b"badw***" not in got
