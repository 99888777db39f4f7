"""Schemas and defaults shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Defaults of the surveyed application.
DEFAULTS = {
    "max_chars": 480,
    "min_chars": 40,
    "min_confidence": 0.55,
    "sentence_gap_ms": 250,
    "paragraph_gap_ms": 600,
    "chapter_gap_ms": 1200,
    "target_db": -18.0,
    "peak_db": -3.0,
    "silence_db": -45.0,
    "clip_db": -0.1,
    "max_silence": 0.65,
    "min_ratio": 0.35,
    "max_ratio": 3.0,
    "max_retries": 2,
    "drift_limit": 0.1,
    "drift_min_jobs": 6,
}
# Rows of the voice vectors, and the states of a job.
VOICE_INDEX = {"narrator": 7306, "dialogue": 1284, "heading": 5022, "alt_male": 6799}
STATUSES = [
    "pending", "parsed", "normalized", "synthesized", "qa_done", "completed", "needs_review", "failed",
]

PAIRS = T.StructType(
    [
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("hard", T.BooleanType()),
    ]
)
AUDIO_QA = T.StructType(
    [
        T.StructField("pass", T.LongType()),
        T.StructField("fail", T.LongType()),
        T.StructField("resynth_attempts", T.LongType()),
    ]
)
JOB_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_segments", T.LongType()),
        T.StructField("n_flagged", T.LongType()),
        T.StructField(
            "metrics",
            T.StructType([T.StructField("rtf", T.DoubleType()), T.StructField("audio_qa", AUDIO_QA)]),
        ),
    ]
)
BLOCK = "array<struct<text:string,is_heading:boolean>>"
