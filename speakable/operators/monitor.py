"""Job-log statistics, drift and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULTS
from .prefix import number_rows


def job_measures(log: DataFrame) -> DataFrame:
    """Per-job rates: flagged share, failed-clip share (null without checks), real-time factor."""
    segments = F.coalesce("n_segments", F.lit(0))
    qa = F.col("metrics.audio_qa")
    passed, failed = F.coalesce(qa["pass"], F.lit(0)), F.coalesce(qa["fail"], F.lit(0))
    return (
        log.withColumn("status", F.coalesce("status", F.lit("?")))
        .withColumn("segments", segments)
        .withColumn("flag_rate", F.coalesce("n_flagged", F.lit(0)) / F.greatest(F.lit(1), segments))
        .withColumn("qa_fail_rate", F.when(passed + failed > 0, failed / (passed + failed)))
        .withColumn("rtf", F.col("metrics.rtf"))
    )


def _mean(total: str, count: str, places: int) -> Column:
    return F.bround(F.try_divide(F.sum(total), F.sum(count)), places)


def window_stats(measures: DataFrame, *keys: str) -> DataFrame:
    """Status mix and mean rates per window; statuses are counted first, so little is shuffled."""
    by_status = measures.groupBy(*keys, "status").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("flag_rate").alias("_flag"),
        F.sum("qa_fail_rate").alias("_qa"),
        F.count("qa_fail_rate").alias("_n_qa"),
        F.sum("rtf").alias("_rtf"),
        F.count("rtf").alias("_n_rtf"),
        F.sum("segments").alias("_segments"),
    )
    listed = F.array_sort(F.collect_list(F.struct("status", "_n")))
    return by_status.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.map_from_entries(listed).alias("statuses"),
        _mean("_flag", "_n", 4).alias("flag_rate"),
        F.coalesce(_mean("_qa", "_n_qa", 4), F.lit(0.0)).alias("qa_fail_rate"),
        _mean("_rtf", "_n_rtf", 4).alias("mean_rtf"),
        _mean("_segments", "_n", 1).alias("mean_segments"),
    )


def _half(condition: Column, prefix: str) -> list[Column]:
    def mean(name: str) -> Column:
        return F.bround(F.avg(F.when(condition, F.col(name))), 4)

    return [
        F.count_if(condition).alias(f"{prefix}_n"),
        mean("flag_rate").alias(f"{prefix}_flag_rate"),
        F.coalesce(mean("qa_fail_rate"), F.lit(0.0)).alias(f"{prefix}_qa_fail_rate"),
        mean("rtf").alias(f"{prefix}_mean_rtf"),
    ]


def drift(
    measures: DataFrame, order: list[str],
    limit: float = DEFAULTS["drift_limit"], min_jobs: int = DEFAULTS["drift_min_jobs"],
) -> DataFrame:
    """First half of the log against the rest, in log order; empty below ``min_jobs``."""
    slim = measures.select(*order, "flag_rate", "qa_fail_rate", "rtf")
    numbered = number_rows(slim, order)
    # One number comes to the driver; the rows are already written.
    total = numbered.count()
    early = F.col("row_no") <= total // 2
    halves = numbered.agg(
        F.count(F.lit(1)).alias("n_jobs"), *_half(early, "base"), *_half(~early, "recent")
    ).filter(F.col("n_jobs") >= min_jobs)

    def delta(name: str) -> Column:
        return F.bround(F.col(f"recent_{name}") - F.col(f"base_{name}"), 4)

    return (
        halves.withColumn("delta_flag_rate", delta("flag_rate"))
        .withColumn("delta_qa_fail_rate", delta("qa_fail_rate"))
        .withColumn("delta_mean_rtf", delta("mean_rtf"))
        .withColumn(
            "alert",
            (F.coalesce("delta_flag_rate", F.lit(0.0)) > limit)
            | (F.coalesce("delta_qa_fail_rate", F.lit(0.0)) > limit),
        )
    )


def latency(timings: DataFrame, ms: str, key: str) -> DataFrame:
    """Exact interpolated p50, p95 and p99, mean and throughput.

    The order statistics come from a distributed numbering; an exact
    percentile aggregate would hold every distinct value in one buffer.
    """
    numbered = number_rows(timings.select(ms, key), [ms, key])
    total = numbered.count()

    def quantile(p: float) -> Column:
        at = max(total - 1, 0) * p
        low = int(at)
        below = F.max(F.when(F.col("row_no") == low + 1, F.col(ms)))
        above = F.max(F.when(F.col("row_no") == min(low + 2, total), F.col(ms)))
        return F.bround(below + (above - below) * (at - low), 2)

    mean = F.avg(ms)
    return numbered.agg(
        F.count(F.lit(1)).alias("n"),
        quantile(0.5).alias("p50"),
        quantile(0.95).alias("p95"),
        quantile(0.99).alias("p99"),
        F.bround(mean, 2).alias("mean"),
        F.bround(1000.0 / F.greatest(F.lit(0.01), mean), 1).alias("per_second"),
    )


def latest_reports(reports: DataFrame, kinds: list[str], order: list[str], payload: str = "payload") -> DataFrame:
    """Newest payload of each kind, null where a kind has none.

    A maximum by key combines before the shuffle, so a kind with most of the
    rows costs no more than any other.
    """
    newest = reports.groupBy("kind").agg(F.max_by(payload, F.struct(*order)).alias(payload))
    wanted = reports.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return wanted.join(newest, "kind", "left")
