"""Harvesting segments worth a second look, and the keyed store that keeps them.

A stored row is keyed by the SHA-256 of its written input and lies in the
folder of the first two digits of that key. Appending reads only the
folders that the new rows fall into and adds what they lack, so a batch that runs again
adds nothing. Keys are spread evenly, so no folder is hot, and a repeated input is
one row however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import path_exists

REASONS = ["correction", "disagreement", "low_confidence", "qa_failure"]
STORE = (
    "input_sha256 string, segment_id string, written string, spoken string, confidence double, baseline string, correction string,"
    " reasons array<string>, model string, ts timestamp, prefix string"
)


def input_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def harvest(
    decided: DataFrame,
    model: str,
    ts: str,
    checks: DataFrame | None = None,
    corrections: DataFrame | None = None,
    key: str = "segment_id",
) -> DataFrame:
    """Segments that were unsure, disagreed with the rules, failed their clip check or were corrected.

    ``decided`` is the result of ``decide_normalization``; ``checks`` has ``key`` and
    ``passed``, ``corrections`` has ``key`` and ``correction``. One row per
    distinct input: of equal inputs the smallest key speaks, with the reasons of all.
    """
    rows = decided
    for extra, column in ((checks, "passed"), (corrections, "correction")):
        if extra is None:
            rows = rows.withColumn(column, F.lit(None).cast("boolean" if column == "passed" else "string"))
        else:
            rows = rows.join(extra.select(key, column).dropDuplicates([key]), key, "left")
    failed = F.col("correction").isNotNull(), F.col("disagree"), F.col("flagged"), ~F.col("passed")
    reasons = F.filter(F.array(*(F.when(c, n) for n, c in zip(REASONS, failed, strict=True))), lambda r: r.isNotNull())
    record = F.struct(
        F.col(key).cast("string").alias("segment_id"), F.col("baseline_text").alias("written"), F.col("normalized").alias("spoken"), "confidence",
        F.col("baseline_text").alias("baseline"), "correction",
    )
    found = rows.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(input_key(F.col("baseline_text")).alias("input_sha256"), record.alias("r"), "reasons")
    # Flags, not lists, meet in the shuffle: four booleans however often an input occurs.
    has = [F.max(F.array_contains("reasons", n)).alias(n) for n in REASONS]
    one = found.groupBy("input_sha256").agg(F.min_by("r", "r.segment_id").alias("r"), *has)
    named = F.filter(F.array(*(F.when(F.col(n), n) for n in REASONS)), lambda r: r.isNotNull())
    return one.select("input_sha256", "r.*", named.alias("reasons"), F.lit(model).alias("model"), F.lit(ts).cast("timestamp").alias("ts"))


def without_known(found: DataFrame, pairs: DataFrame, before: str = "before") -> DataFrame:
    """Harvested rows whose input is no training pair yet; digests meet, not texts."""
    known = pairs.select(input_key(F.col(before)).alias("input_sha256")).distinct()
    return found.join(known, "input_sha256", "left_anti")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store; a store that was never written is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).parquet(path)


def append_feedback(found: DataFrame, path: str) -> None:
    """Add the rows whose key the store lacks; at most 256 folder names reach the driver."""
    spark = found.sparkSession
    columns = [c.split()[0] for c in STORE.replace(", ", ",").split(",")]
    rows = found.withColumn("prefix", F.substring("input_sha256", 1, 2)).select(*columns).dropDuplicates(["input_sha256"])
    prefixes = [r["prefix"] for r in rows.select("prefix").distinct().collect()]
    old = read_feedback(spark, path).filter(F.col("prefix").isin(prefixes)).select("prefix", "input_sha256")
    rows.join(old, ["prefix", "input_sha256"], "left_anti").write.mode("append").partitionBy("prefix").parquet(path)
