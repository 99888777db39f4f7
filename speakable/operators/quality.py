"""Quality decisions on documents and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SPACE, squash
from ..schemas import DEFAULTS

def spoken_only(segments: DataFrame) -> DataFrame:
    """Segments that are read aloud."""
    return segments.filter(F.col("kind") != "skippable")


def route_voice(kind: Column, heading: str = "heading", dialogue: str = "dialogue", narrator: str = "narrator") -> Column:
    return F.when(kind == "heading", heading).when(kind == "dialogue", dialogue).otherwise(narrator)


def parse_route(score: Column) -> Column:
    return F.when(score >= 0.85, "structured").when(score >= 0.5, "assisted").otherwise("degraded")


def retry_plan(attempt: Column) -> Column:
    return F.when(attempt == 0, "reseed_jitter").when(attempt == 1, "split_and_pad").otherwise("fallback_backend")


def doc_stats(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chapters, segments, spoken segments and characters per document."""
    return segments.groupBy(doc).agg(
        (F.max("chapter_index") + 1).alias("n_chapters"),
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("kind") != "skippable").alias("n_spoken"),
        F.sum(F.length("text")).alias("total_chars"),
    )


def parse_score(segments: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Structure score of each document, including those without segments.

    Sums are combined before the shuffle, so one row per document and task moves.
    """
    is_spoken = F.col("kind") != "skippable"
    letters = F.length(F.regexp_replace("text", rf"[^\p{{L}}{SPACE}]", ""))
    sums = segments.groupBy(doc).agg(
        F.count_if(is_spoken).alias("n"),
        F.sum(F.when(is_spoken, F.length("text"))).alias("chars"),
        F.sum(F.when(is_spoken, letters)).alias("letters"),
        F.max("chapter_index").alias("last_chapter"),
        F.max((F.col("kind") == "heading").cast("int")).alias("headings"),
    )
    mean_chars = F.col("chars") / F.col("n")
    structured = (F.col("last_chapter") > 0) | (F.col("headings") > 0)
    score = (
        F.lit(0.5) * (F.col("letters") / F.col("chars"))
        + F.lit(0.3) * F.when(structured, 1.0).otherwise(0.65)
        + F.lit(0.2) * F.when(mean_chars.between(10, 2000), 1.0).otherwise(0.5)
    )
    return (
        documents.select(doc)
        .join(sums, doc, "left")
        .select(
            doc,
            F.when(F.coalesce("n", F.lit(0)) == 0, 0.0)
            .when(F.col("chars") < 20, 0.15)
            .otherwise(F.bround(F.least(F.lit(1.0), score), 4))
            .alias("parse_score"),
        )
        .withColumn("route", parse_route(F.col("parse_score")))
    )


def join_model_baseline(baseline: DataFrame, model: DataFrame, key: str = "segment_id") -> DataFrame:
    """Baseline text beside the model's text and confidence; null where there is none."""
    return baseline.join(
        model.select(key, F.col("text").alias("model_text"), F.col("confidence").alias("model_confidence")),
        key,
        "left",
    )


def decide_normalization(joined: DataFrame, min_confidence: float = DEFAULTS["min_confidence"]) -> DataFrame:
    """Pick model or baseline text; low confidence flags, disagreement only counts."""
    none = F.col("model_text").isNull()
    low = ~none & (F.col("model_confidence") < min_confidence)
    return (
        joined.withColumn("source", F.when(none, "rule").otherwise("neural"))
        .withColumn("normalized", F.coalesce("model_text", "baseline_text"))
        .withColumn("confidence", F.when(none, 1.0).otherwise(F.col("model_confidence")))
        .withColumn("flagged", low)
        .withColumn("escalate", low)
        .withColumn(
            "flag_reason",
            F.when(low, F.format_string("low confidence %.2f", F.col("model_confidence"))).otherwise(""),
        )
        .withColumn("disagree", ~none & (squash(F.col("model_text")) != squash(F.col("baseline_text"))))
    )


def normalization_summary(decided: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per-document counts and the branch taken."""
    escalated = F.count_if("escalated") if "escalated" in decided.columns else F.lit(0).cast("bigint")
    out = decided.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("flagged").alias("n_flagged"),
        escalated.alias("n_escalated"),
        F.count_if("disagree").alias("n_disagree"),
        F.bround(F.avg("confidence"), 4).alias("mean_confidence"),
    )
    return out.withColumn(
        "branch",
        F.when(F.col("n_escalated") > 0, "escalated").when(F.col("n_flagged") > 0, "flagged").otherwise("confident"),
    )


def voice_counts(voiced: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Segments per voice, as a branch name and a sorted text."""
    counts = voiced.groupBy(doc, "voice").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("voice", "n")))
    return counts.groupBy(doc).agg(
        F.when(F.count(F.lit(1)) > 1, "multi").otherwise("single").alias("branch"),
        F.array_join(
            F.transform(listed, lambda v: F.concat(v["voice"], F.lit(":"), v["n"].cast("string"))), ", "
        ).alias("detail"),
    )


def clip_gate(checked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Passed and failed clips per document."""
    out = checked.groupBy(doc).agg(
        F.count_if("passed").alias("n_pass"),
        F.count_if(~F.col("passed")).alias("n_fail"),
        F.sum("attempts").alias("resynth_attempts"),
    )
    total = F.greatest(F.lit(1), F.col("n_pass") + F.col("n_fail"))
    return out.withColumn("branch", F.when(F.col("n_fail") == 0, "all_pass").otherwise("some_failed")).withColumn(
        "score", F.bround(F.col("n_pass") / total, 4)
    )


def job_status(documents: DataFrame, segments: DataFrame, doc: str = "doc_id", text_only: bool = False) -> DataFrame:
    """Final state of each document."""
    sums = segments.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if("flagged").alias("n_flagged")
    )
    done = F.lit("normalized") if text_only else F.when(F.col("n_flagged") > 0, "needs_review").otherwise("completed")
    return (
        documents.select(doc)
        .join(sums, doc, "left")
        .select(
            doc,
            F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
            F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"),
        )
        .withColumn("status", F.when(F.col("n_segments") == 0, "failed").otherwise(done))
    )


def sequence_confidence(log_probs: Column) -> Column:
    """exp of the mean of the finite log-probabilities; 0 without any."""
    finite = F.filter(log_probs, lambda p: ~F.isnan(p) & (F.abs(p) != float("inf")))
    mean = F.aggregate(finite, F.lit(0.0), lambda a, p: a + p) / F.size(finite)
    return F.when(F.coalesce(F.size(finite), F.lit(0)) <= 0, 0.0).otherwise(F.exp(mean))
