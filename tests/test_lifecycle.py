"""Feedback, model versions and privacy: planted cases."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speakable.operators import feedback as B
from speakable.operators import privacy as P
from speakable.operators import versions as V

DECIDED = "segment_id string, baseline_text string, normalized string, confidence double, flagged boolean, disagree boolean"


def test_harvest_keeps_one_row_per_input_with_all_reasons(spark):
    rows = [("a", "x", "x", 0.9, False, False), ("b", "y", "y!", 0.9, False, True), ("c", "y", "y", 0.2, True, False), ("d", "z", "z", 0.9, False, False), ("e", "k", "k", 0.1, True, False)]
    checks = spark.createDataFrame([("d", False), ("d", False), ("a", True)], "segment_id string, passed boolean")
    fixed = spark.createDataFrame([("c", "why")], "segment_id string, correction string")
    found = B.harvest(spark.createDataFrame(rows, DECIDED), "m1", "2024-01-01 00:00:00", checks, fixed)
    got = {r.written: r for r in found.collect()}
    assert {k: (r.segment_id, r.reasons) for k, r in got.items()} == {
        "y": ("b", ["correction", "disagreement", "low_confidence"]), "z": ("d", ["qa_failure"]), "k": ("e", ["low_confidence"]),
    }
    assert got["y"].input_sha256 == hashlib.sha256(b"y").hexdigest() and got["y"].spoken == "y!"
    left = B.without_known(found, spark.createDataFrame([("z",), ("x",)], "before string"))
    assert {r.written for r in left.collect()} == {"y", "k"}


def test_a_batch_that_runs_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert B.read_feedback(spark, path).count() == 0
    rows = [(f"s{k}", f"text {k % 40}", "t", 0.1, True, False) for k in range(60)]
    found = B.harvest(spark.createDataFrame(rows, DECIDED), "m1", "2024-01-01 00:00:00")
    B.append_feedback(found.filter("input_sha256 < '9'"), path)
    some = B.read_feedback(spark, path).count()
    B.append_feedback(found, path)
    before = sorted((tmp_path / "store").rglob("*.parquet"))
    B.append_feedback(found.withColumn("model", F.lit("m2")), path)
    assert 0 < some < 40 and B.read_feedback(spark, path).count() == 40
    assert sorted((tmp_path / "store").rglob("*.parquet")) == before
    assert {r.model for r in B.read_feedback(spark, path).select("model").collect()} == {"m1"}


def test_a_class_that_falls_while_the_total_rises(spark):
    rows = []
    for k in range(20):
        rows += [("v1", k, ["DATE"], k % 2 == 0), ("v2", k, ["DATE"], k != 3)]
    for k in range(20, 24):
        rows += [("v1", k, ["MONEY", "PLAIN"], True), ("v2", k, ["MONEY", "PLAIN"], k != 21)]
    rows += [("v1", 30, ["TIME"], True), ("v2", 31, [], True), ("v3", 0, ["DATE"], True)]
    got = {(r.version, r.cls): r for r in V.golden_regression(spark.createDataFrame(rows, "version string, pair_id int, classes array<string>, correct boolean")).collect()}
    assert (got["v2", "DATE"].n_won, got["v2", "DATE"].n_lost, got["v2", "DATE"].status) == (9, 0, "held")
    assert (got["v2", "MONEY"].n_lost, got["v2", "MONEY"].accuracy, got["v2", "MONEY"].status) == (1, 0.75, "regressed")
    assert got["v2", "TIME"].status == "missing" and got["v2", "TIME"].n == 0 and got["v2", "TIME"].accuracy is None
    assert (got["v2", "PLAIN"].n, got["v2", "PLAIN"].accuracy) == (5, 0.8) and got["v1", "TIME"].status == "first"
    assert got["v3", "PLAIN"].status == "missing" and got["v3", "DATE"].n_before == 20
    total = lambda v: sum(r.n * (r.accuracy or 0) for r in got.values() if r.version == v)
    assert total("v2") > total("v1")
    assert V.golden_regression(spark.createDataFrame([], "version string, pair_id int, classes array<string>, correct boolean")).count() == 0


def test_left_shift_below_the_flag_threshold(spark):
    value = lambda rows: spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, c double")
    base = value([("a", 0.9)] * 90 + [("a", 0.3)] * 10 + [("b", 0.9)] * 10 + [("c", 1.0)])
    recent = value([("a", 0.7)] * 90 + [("a", 0.3)] * 10 + [("b", 0.95)] * 10 + [("d", 1.0)])
    got = {r.k: r for r in V.histogram_shift(V.histogram(base, "c", "k"), V.histogram(recent, "c", "k"), "k").collect()}
    assert (got["a"].gap, got["a"].edge, got["a"].left_shift) == (0.9, 0.75, True)
    assert (got["b"].gap, got["b"].left_shift) == (-1.0, False)
    assert got["c"].gap is None and got["d"].gap is None and not got["d"].left_shift
    odd = V.histogram(value([("a", -3), ("a", 0), ("a", 1), ("a", 7), ("a", float("nan"))]).unionAll(spark.createDataFrame([("a", None)], "k string, c double")), "c", "k")
    assert {r.bin: r.n for r in odd.collect()} == {0: 2, 19: 2}
    assert {r.bin: r.n for r in V.merged(odd.unionAll(odd), "k").collect()} == {0: 4, 19: 4}


def metrics(spark, **values):
    rows = [(*name.split("__"), v) for name, v in values.items()]
    return spark.createDataFrame([(s, V.CLASS + m[6:] if m.startswith("class_") else m, v) for s, m, v in rows], "slice string, metric string, value double")


BASE = {"test__sentence_accuracy": 0.9, "hard__sentence_accuracy": 0.5, "test__macro_class_accuracy": 0.8, "test__class_DATE": 0.7}


@pytest.mark.parametrize(
    ("change", "reasons"),
    [
        ({"test__sentence_accuracy": 0.91, "hard__sentence_accuracy": 0.51}, ""),
        ({"test__sentence_accuracy": 0.91}, "hard: sentence_accuracy tie"),
        ({"test__sentence_accuracy": 0.91, "hard__sentence_accuracy": 0.4}, "hard: sentence_accuracy below incumbent"),
        ({"test__sentence_accuracy": 0.91, "hard__sentence_accuracy": 0.51, "test__macro_class_accuracy": 0.79}, "test: macro_class_accuracy macro fell"),
        ({"test__sentence_accuracy": 0.91, "hard__sentence_accuracy": 0.51, "test__class_DATE": "gone"}, "test: class:DATE missing"),
        ({"test__sentence_accuracy": None, "hard__sentence_accuracy": "gone"}, "hard: sentence_accuracy missing; test: sentence_accuracy undefined"),
        ({"test__sentence_accuracy": 0.91, "hard__sentence_accuracy": 0.51, "test__class_TIME": 0.1, "new__sentence_accuracy": 1.0}, "new: sentence_accuracy no incumbent value"),
    ],
)
def test_gate(spark, change, reasons):
    new = {k: v for k, v in (BASE | change).items() if v != "gone"}
    checks = V.gate_checks(metrics(spark, **new), metrics(spark, **BASE), "slice")
    row = V.promotion_gate(checks, "slice").first()
    assert row.reasons == reasons and row.promoted == (reasons == "")


def test_nothing_is_promoted_without_a_score(spark):
    only = metrics(spark, test__class_DATE=0.7)
    assert not V.promotion_gate(V.gate_checks(only, only, "slice"), "slice").first().promoted


def test_redaction_and_offsets(spark):
    rows = [
        (1, "Call 555-123-4567 or mail a.b@host.example before 9:30, room 12, for $5.", "narration"),
        (2, "555-123-4567", "dialogue"), (3, "Nothing here.", "narration"), (4, "", "narration"), (5, None, "narration"),
    ]
    segs = spark.createDataFrame(rows, "id int, text string, kind string")
    got = {r.id: r for r in P.redacted(segs).collect()}
    one = got[1]
    assert one.redacted == "Call [PHONE] or mail [LINK] before 9:30, room 12, for $5." and one.n_sensitive == 2 and one.kind == "narration"
    assert one.rest and all(one.redacted[s.new_start : s.new_stop] == rows[0][1][s.start : s.stop] for s in one.rest)
    assert {"9:30", "12", "$5"} <= {rows[0][1][s.start : s.stop] for s in one.rest}
    assert (got[2].kind, got[2].redacted, got[2].sensitive_share) == ("skippable", "[PHONE]", 1.0)
    assert (got[3].redacted, got[4].redacted, got[5].redacted, got[5].rest) == ("Nothing here.", "", None, [])
    spans = spark.createDataFrame([([(0, 5), (3, 9), (20, 22), (4, 6)],)], "s array<struct<start:int,stop:int>>")
    assert spans.select(P.union_length(F.col("s"))).first()[0] == 11


def test_logs_hold_no_text(spark):
    segs = spark.createDataFrame([(1, "Call 555-123-4567 or mail secret.name@host.example, pay $77."), (2, None)], "id int, text string")
    log = P.span_log(segs, "id")
    rows = log.collect()
    assert {r.cls for r in rows if r.sensitive} == {"TELEPHONE", "ELECTRONIC"} and len(rows) == 3
    said = " ".join(str(tuple(r)) for r in rows)
    assert not any(t in said for t in ("555", "4567", "secret", "host", "77."))
    with pytest.raises(ValueError, match="text"):
        P.span_log(segs, "id", "text")
    nested = T.StructType([T.StructField("n", T.LongType()), T.StructField("deep", T.ArrayType(T.StructType([T.StructField("s", T.StringType())])))])
    with pytest.raises(ValueError, match="deep"):
        P.check_text_free(nested, ())
