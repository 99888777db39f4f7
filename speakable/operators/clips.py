"""Checks and loudness over audio-clip tables with sample arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULTS

SECONDS_PER_CHAR = 0.06
MIN_SECONDS = 0.3


def expected_seconds(text: Column) -> Column:
    """Seconds of speech a text should take."""
    return F.greatest(F.length(text) * SECONDS_PER_CHAR, F.lit(MIN_SECONDS))


def rtf(synth_seconds: Column, audio_seconds: Column) -> Column:
    """Compute seconds per audio second; null without audio."""
    return F.when(audio_seconds > 0, F.bround(synth_seconds / audio_seconds, 4))


def power(samples: Column) -> Column:
    """Sum of squares of a sample array."""
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def peak(samples: Column) -> Column:
    """Largest magnitude of a sample array, 0 if empty."""
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def _decibels(x: Column) -> Column:
    return F.bround(20 * F.log10(x + 1e-9), 2)


def clip_qa(clips: DataFrame) -> DataFrame:
    """Acoustic checks of each clip ``(sr, text, samples)``; no shuffle."""
    n = F.size("samples")
    floor = 10 ** (DEFAULTS["silence_db"] / 20)
    ceiling = 10 ** (DEFAULTS["clip_db"] / 20)
    quiet = F.size(F.filter("samples", lambda x: F.abs(x.cast("double")) < floor))
    measured = (
        clips.withColumn("n_samples", n)
        .withColumn("_seconds", F.when(F.col("sr") > 0, n / F.col("sr")).otherwise(0.0))
        .withColumn("_ratio", F.col("_seconds") / expected_seconds(F.col("text")))
        .withColumn("_peak", peak(F.col("samples")))
        .withColumn("_rms", F.when(n > 0, F.sqrt(power(F.col("samples")) / n)).otherwise(0.0))
        .withColumn("_quiet", F.when(n > 0, quiet / n).otherwise(1.0))
    )
    checked = (
        measured.withColumn("empty", (n == 0) | (F.col("_rms") < 1e-5))
        .withColumn("duration", F.bround("_seconds", 3))
        .withColumn("duration_ratio", F.bround("_ratio", 3))
        .withColumn("duration_ok", F.col("_ratio").between(DEFAULTS["min_ratio"], DEFAULTS["max_ratio"]))
        .withColumn("peak_dbfs", _decibels(F.col("_peak")))
        .withColumn("clipped", F.col("_peak") >= ceiling)
        .withColumn("rms_dbfs", _decibels(F.col("_rms")))
        .withColumn("silence_frac", F.bround("_quiet", 3))
        .withColumn("too_silent", F.col("_quiet") > DEFAULTS["max_silence"])
    )
    return (
        checked.withColumn(
            "passed",
            ~F.col("empty") & F.col("duration_ok") & ~F.col("clipped") & ~F.col("too_silent"),
        )
        .withColumn("action", F.when(F.col("passed"), "accept").otherwise("resynth"))
        .drop("_seconds", "_ratio", "_peak", "_rms", "_quiet")
    )


def pick_attempt(checked: DataFrame, *keys: str, max_retries: int = DEFAULTS["max_retries"]) -> DataFrame:
    """Chosen attempt of each segment.

    Attempt 0 is the original. Retries stop at the first pass; a retry
    replaces the current clip if it passes or its duration ratio is nearer 1.
    At most ``max_retries + 1`` attempts are gathered per segment.
    """
    gathered = (
        checked.filter(F.col("attempt") <= max_retries)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("attempt", "passed", "duration_ratio"))).alias("tries"))
    )
    first = F.get("tries", F.lit(0))
    start = F.struct(
        first["attempt"].alias("attempt"),
        first["passed"].alias("passed"),
        first["duration_ratio"].alias("duration_ratio"),
        F.lit(0).alias("attempts"),
    )

    def step(acc: Column, t: Column) -> Column:
        nearer = F.abs(t["duration_ratio"] - 1) < F.abs(acc["duration_ratio"] - 1)
        used = acc["attempts"] + 1
        return (
            F.when(acc["passed"], acc)
            .when(
                t["passed"] | nearer,
                F.struct(
                    t["attempt"].alias("attempt"),
                    t["passed"].alias("passed"),
                    t["duration_ratio"].alias("duration_ratio"),
                    used.alias("attempts"),
                ),
            )
            .otherwise(
                F.struct(
                    acc["attempt"].alias("attempt"),
                    acc["passed"].alias("passed"),
                    acc["duration_ratio"].alias("duration_ratio"),
                    used.alias("attempts"),
                )
            )
        )

    chosen = F.aggregate(F.slice("tries", 2, max(max_retries, 1)), start, step)
    return gathered.select(*keys, chosen.alias("c")).select(*keys, "c.*")


def clip_report(checked: DataFrame) -> DataFrame:
    """Averages over all checked clips."""
    n = F.count(F.lit(1))
    return checked.agg(
        n.alias("n_segments"),
        F.bround(F.count_if("passed") / F.greatest(F.lit(1), n), 4).alias("pass_rate"),
        F.count_if(~F.col("passed")).alias("n_fail"),
        F.bround(F.avg("duration_ratio"), 3).alias("avg_duration_ratio"),
        F.bround(F.avg("peak_dbfs"), 3).alias("avg_peak_dbfs"),
        F.bround(F.avg("rms_dbfs"), 3).alias("avg_rms_dbfs"),
        F.bround(F.avg("silence_frac"), 3).alias("avg_silence_frac"),
    )


def book_gain(
    clips: DataFrame, doc: str = "doc_id", silence: Column | None = None,
    target_db: float = DEFAULTS["target_db"], peak_db: float = DEFAULTS["peak_db"],
) -> DataFrame:
    """Gain per document: to the target RMS, then under the peak ceiling.

    ``silence`` counts silent samples after a clip, which belong to the book.
    """
    quiet = F.lit(0) if silence is None else silence
    sums = clips.select(
        doc,
        power(F.col("samples")).alias("_power"),
        (F.size("samples") + quiet).alias("_n"),
        peak(F.col("samples")).alias("_peak"),
    ).groupBy(doc).agg(F.sum("_power").alias("_power"), F.sum("_n").alias("_n"), F.max("_peak").alias("_peak"))
    rms = F.sqrt(F.col("_power") / F.greatest(F.lit(1), F.col("_n")))
    gain = 10 ** (target_db / 20) / F.when(rms > 0, rms).otherwise(1e-9)
    loudest = F.col("_peak") * F.col("_gain")
    ceiling = 10 ** (peak_db / 20)
    return sums.withColumn("_gain", gain).select(
        doc, F.when(loudest > ceiling, F.col("_gain") * ceiling / loudest).otherwise(F.col("_gain")).alias("gain")
    )


def book_loudness(clips: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """Scale every clip by its document's gain and clip to +-1."""
    louder = F.transform(
        "samples",
        lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * F.col("gain"))).cast("float"),
    )
    return clips.join(book_gain(clips, doc, **options), doc).withColumn("samples", louder)
