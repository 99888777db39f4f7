"""The job as one plan, from documents to states."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import ARTICLE, BOOK
from speakable.operators import blocks as B
from speakable.operators import job as J
from speakable.operators import quality as Q

DECIDED = "segment_id string, doc_id int, kind string, text string, chapter_index int, baseline_text string, model_text string, model_confidence double"


def decided(spark):
    rows = [
        ("a", 1, "narration", "one", 0, "one", "one", 0.9), ("b", 1, "narration", "two", 0, "two", "too", 0.2), ("c", 1, "dialogue", "three", 0, "three", "three", 0.3),
        ("d", 2, "narration", "four", 0, "four", None, None), ("e", 3, "skippable", "page 5", 0, "page 5", None, None),
    ]
    return Q.decide_normalization(spark.createDataFrame(rows, DECIDED))


def test_adviser_settles_only_rows_that_ask(spark):
    advice = spark.createDataFrame([("a", "never used", "x"), ("b", "two, then", "y" * 80), ("b", "two, then", "y" * 80)], "segment_id string, text string, rationale string")
    got = {r.segment_id: r for r in J.escalate(decided(spark), advice).collect()}
    assert len(got) == 5 and [k for k, r in got.items() if r.escalated] == ["b"]
    assert (got["b"].normalized, got["b"].source, got["b"].flagged, got["b"].flag_reason) == ("two, then", "llm", False, "llm: " + "y" * 60)
    assert got["a"].normalized == "one" and got["c"].flagged and got["c"].flag_reason == "low confidence 0.30"


def test_failed_clips_flag_their_segment(spark):
    checks = spark.createDataFrame([("a", False), ("c", False), ("c", False), ("d", True)], "segment_id string, passed boolean")
    got = {r.segment_id: r for r in J.flag_failed_clips(decided(spark), checks).collect()}
    assert (got["a"].flagged, got["a"].flag_reason) == (True, "audio_qa_failed")
    assert (got["c"].flagged, got["c"].flag_reason) == (True, "low confidence 0.30; audio_qa_failed")
    assert not got["d"].flagged and got["d"].flag_reason == "" and not got["e"].flagged and got["e"].passed is None and len(got) == 5


def test_states(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int")
    rows = J.flag_failed_clips(decided(spark).withColumn("escalated", F.lit(False)), spark.createDataFrame([("d", True)], "segment_id string, passed boolean"))
    got = {r.doc_id: r for r in J.job_states(docs, rows.withColumn("voice", Q.route_voice(F.col("kind")))).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "needs_review", 2: "completed", 3: "failed", 4: "failed"}
    assert (got[1].normalization, got[1].voices, got[1].n_flagged, got[1].n_disagree) == ("flagged", "dialogue:1, narrator:2", 2, 1)
    assert got[3].n_chapters == 1 and got[3].n_segments == 0 and got[4].n_chapters == 0 and got[4].mean_confidence is None


def test_whole_job_of_a_book(spark):
    docs = spark.createDataFrame([("book", BOOK), ("blank", " \n\n"), ("null", None)], "doc_id string, text string")
    none = spark.createDataFrame([], "segment_id string, text string, confidence double")
    text = {r.doc_id: r for r in J.run_job(docs, B.text_blocks(F.col("text")), none).collect()}
    assert text["book"].status == "normalized" and text["blank"].status == "failed" and text["null"].status == "failed"
    assert text["book"].n_chapters >= 2 and text["book"].n_segments >= 4 and text["book"].route == "structured"
    checks = spark.range(40).select(F.concat(F.lit("book-0-"), F.col("id").cast("string")).alias("segment_id"), (F.col("id") != 0).alias("passed"))
    with_clips = {r.doc_id: r for r in J.run_job(docs, B.text_blocks(F.col("text")), none, checks).collect()}
    book = with_clips["book"]
    assert (book.status, book.n_fail, book.clips, book.normalization) == ("needs_review", 1, "some_failed", "confident")
    good = J.run_job(docs, B.text_blocks(F.col("text")), none, checks.withColumn("passed", F.lit(True))).filter("doc_id = 'book'").first()
    assert good.status == "completed" and good.clips == "all_pass" and "narrator" in good.voices
    article = spark.createDataFrame([("a", ARTICLE)], "doc_id string, text string")
    assert J.run_job(article, B.markdown_blocks(F.col("text")), none).first().status == "normalized"
