"""The context reader beats the rules on hard rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from speakable.functions.scanning import normalize
from speakable.operators import pairs as P
from speakable.operators import reader as R
from speakable.operators import score as C
from speakable.operators.prefix import durable


def test_reader_beats_rules_on_hard(spark):
    train = durable(P.generate_pairs(spark.range(1500)))
    hard = durable(P.without_leaks(P.generate_pairs(spark.range(200), hard_only=True), train))
    said = R.read_in_context(R.fit_reader(train), hard)
    reader = C.score(C.join_pred_gold(hard, said)).first()
    rules = C.score(C.join_pred_gold(hard, hard.select("pair_id", normalize(F.col("before")).alias("text")))).first()
    assert rules.sentence_accuracy < 0.2
    assert reader.sentence_accuracy > 0.6
    assert said.filter("confidence < 0.5 or confidence > 1").count() == 0


def test_texts_are_scanned_once_for_tuning(spark, monkeypatch):
    rows = durable(P.generate_pairs(spark.range(1500)))
    assert "Join" not in R.training_rows(rows)._jdf.queryExecution().executedPlan().toString()
    kept = []
    monkeypatch.setattr(R, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    assert R.tune_reader(rows, [0.001]).count() == 1
    assert len(kept) == 1 and kept[0].count() > 100
