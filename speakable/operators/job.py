"""A whole job as one plan: segments to decisions to the state of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import SPACE
from ..functions.scanning import normalize
from .quality import decide_normalization, join_model_baseline, parse_route, route_voice
from .segments import segments

FAILED_CLIP = "audio_qa_failed"


def escalate(decided: DataFrame, advice: DataFrame, key: str = "segment_id") -> DataFrame:
    """Let an adviser settle the rows that ask for it.

    ``advice`` has ``key``, ``text`` and ``rationale``. A row that asked and got an
    answer takes its text, is no longer flagged and counts as ``escalated``; others stay.
    """
    said = advice.select(key, F.col("text").alias("_text"), F.coalesce("rationale", F.lit("")).alias("_why")).dropDuplicates([key])
    rows = decided.join(said, key, "left").withColumn("escalated", F.col("escalate") & F.col("_text").isNotNull())
    took = F.col("escalated")
    return (
        rows.withColumn("normalized", F.when(took, F.col("_text")).otherwise(F.col("normalized")))
        .withColumn("source", F.when(took, "llm").otherwise(F.col("source")))
        .withColumn("flagged", F.col("flagged") & ~took)
        .withColumn("flag_reason", F.when(took, F.concat(F.lit("llm: "), F.left("_why", F.lit(60)))).otherwise(F.col("flag_reason")))
        .drop("_text", "_why")
    )


def flag_failed_clips(decided: DataFrame, checks: DataFrame, key: str = "segment_id") -> DataFrame:
    """Adds ``passed``; a segment whose clip failed is flagged, and says so behind its other reason.

    A segment without a checked clip has neither passed nor failed.
    """
    rows = decided.join(checks.select(key, "passed").dropDuplicates([key]), key, "left")
    failed = F.coalesce(~F.col("passed"), F.lit(False))
    reason = F.btrim(F.concat("flag_reason", F.lit(f"; {FAILED_CLIP}")), F.lit("; "))
    return rows.withColumn("flag_reason", F.when(failed, reason).otherwise(F.col("flag_reason"))).withColumn("flagged", F.col("flagged") | failed)


def job_rows(
    segs: DataFrame, model: DataFrame, checks: DataFrame | None = None, advice: DataFrame | None = None, doc: str = "doc_id"
) -> DataFrame:
    """Segments (doc, segment_id, chapter_index, kind, text) with their baseline, decision, voice and flags."""
    rows = segs.withColumn("baseline_text", normalize(F.col("text")))
    rows = decide_normalization(join_model_baseline(rows, model))
    rows = rows.withColumn("escalated", F.lit(False)) if advice is None else escalate(rows, advice)
    rows = rows.withColumn("passed", F.lit(None).cast("boolean")) if checks is None else flag_failed_clips(rows, checks)
    return rows.withColumn("voice", route_voice(F.col("kind")))


def job_states(documents: DataFrame, rows: DataFrame, doc: str = "doc_id", text_only: bool = False) -> DataFrame:
    """Score, branches, counts and state of every document, in one aggregation over its segments.

    Skippable segments count for nothing but the number of chapters. A document
    without spoken segments has failed; else it is ``normalized`` without
    clips, and with them needs review if anything is flagged.
    """
    spoken = F.col("kind") != "skippable"
    letters = F.length(F.regexp_replace("text", rf"[^\p{{L}}{SPACE}]", ""))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(spoken, value)), F.lit(0))

    count = lambda condition: F.count_if(spoken & F.coalesce(condition, F.lit(False)))
    voices = ["dialogue", "heading", "narrator"]
    sums = rows.groupBy(doc).agg(
        (F.max("chapter_index") + 1).alias("n_chapters"),
        F.count_if(spoken).alias("n_segments"),
        total(F.length("text")).alias("_chars"),
        total(letters).alias("_letters"),
        F.max((F.col("kind") == "heading").cast("int")).alias("_headed"),
        count(F.col("flagged")).alias("n_flagged"),
        count(F.col("escalate") & ~F.col("escalated")).alias("_unsure"),
        count(F.col("escalated")).alias("n_escalated"),
        count(F.col("disagree")).alias("n_disagree"),
        F.sum(F.when(spoken, F.col("confidence").cast("decimal(20,8)"))).cast("double").alias("_sure"),
        count(F.col("passed")).alias("n_pass"),
        count(~F.col("passed")).alias("n_fail"),
        *(count(F.col("voice") == v).alias(f"_{v}") for v in voices),
    )
    mean = F.col("_chars") / F.col("n_segments")
    structured = (F.col("n_chapters") > 1) | (F.col("_headed") > 0)
    score = (
        F.lit(0.5) * (F.col("_letters") / F.col("_chars"))
        + F.lit(0.3) * F.when(structured, 1.0).otherwise(0.65)
        + F.lit(0.2) * F.when(mean.between(10, 2000), 1.0).otherwise(0.5)
    )
    out = documents.select(doc).join(sums, doc, "left")
    zero = ["n_chapters", "n_segments", "n_flagged", "n_escalated", "n_disagree", "n_pass", "n_fail"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    none = F.col("n_segments") == 0
    parts = F.array(*(F.when(F.coalesce(f"_{v}", F.lit(0)) > 0, F.concat(F.lit(f"{v}:"), F.col(f"_{v}").cast("string"))) for v in voices))
    heard = F.filter(parts, lambda v: v.isNotNull())
    done = F.lit("normalized") if text_only else F.when(F.col("n_flagged") > 0, "needs_review").otherwise("completed")
    out = (
        # Summed as decimals, so the mean does not depend on the order of the rows.
        out.withColumn("mean_confidence", F.when(~none, F.bround(F.col("_sure") / F.col("n_segments"), 4)))
        .withColumn("parse_score", F.when(none, 0.0).when(F.col("_chars") < 20, 0.15).otherwise(F.bround(F.least(F.lit(1.0), score), 4)))
        .withColumn("route", parse_route(F.col("parse_score")))
        .withColumn("normalization", F.when(F.col("n_escalated") > 0, "escalated").when(F.col("_unsure") > 0, "flagged").otherwise("confident"))
        .withColumn("clips", F.when(F.col("n_fail") == 0, "all_pass").otherwise("some_failed"))
        .withColumn("voices", F.array_join(heard, ", "))
        .withColumn("status", F.when(none, "failed").otherwise(done))
    )
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def run_job(
    documents: DataFrame, blocks: Column, model: DataFrame, checks: DataFrame | None = None, advice: DataFrame | None = None, doc: str = "doc_id"
) -> DataFrame:
    """Documents to their states: segmented, read by rules and model, voiced, checked and summed up.

    Segments are named ``document-chapter-order``; model, checks and advice go by that name.
    Without checks the job ends with its texts.
    """
    segs = segments(documents, blocks, doc).withColumn("segment_id", F.concat_ws("-", doc, "chapter_index", "seg_order"))
    return job_states(documents, job_rows(segs, model, checks, advice, doc), doc, text_only=checks is None)
