"""The batch operators over unbounded inputs: documents and job records that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scanning import normalize
from ..operators.blocks import pasted_blocks
from ..operators.monitor import job_measures
from ..operators.segments import segments
from ..operators.versions import BINS, bin_of
from ..schemas import DEFAULTS, STATUSES
from ..sources.readers import path_exists


def normalize_documents(stream: DataFrame, text: str = "text", doc: str = "doc_id", sep: str | None = None) -> DataFrame:
    """Arriving documents to normalized segments; stateless, same expressions as in batch."""
    blocks = pasted_blocks(F.col(text)) if sep is None else pasted_blocks(F.col(text), sep)
    return segments(stream, blocks, doc).withColumn("normalized", normalize(F.col("text")))


def job_windows(
    log: DataFrame, window: str = "1 day", watermark: str = "1 hour", statuses: list[str] | None = None
) -> DataFrame:
    """Statistics per event-time window; rows later than the watermark are dropped.

    One pass allows no nested count, so each known status has its own column.
    """
    names = statuses or STATUSES

    def mean(name: str, places: int = 4) -> Column:
        return F.bround(F.avg(name), places)

    return (
        job_measures(log)
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names],
            mean("flag_rate").alias("flag_rate"),
            F.coalesce(mean("qa_fail_rate"), F.lit(0.0)).alias("qa_fail_rate"),
            mean("rtf").alias("mean_rtf"),
            mean("segments", 1).alias("mean_segments"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*")
        .drop("window")
    )


def confidence_windows(rows: DataFrame, value: str = "confidence", window: str = "1 day", watermark: str = "1 hour", bins: int = BINS) -> DataFrame:
    """Histogram of confidences per event-time window, one row per window and bin; windows merge by adding ``n``."""
    return (
        rows.withWatermark("ts", watermark)
        .withColumn("bin", bin_of(F.col(value), bins))
        .filter("bin IS NOT NULL")
        .groupBy(F.window("ts", window).alias("window"), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "bin", "n")
    )


def dedup_jobs(log: DataFrame, watermark: str = "1 hour", keys: tuple[str, ...] = ("filename", "ts")) -> DataFrame:
    """Drop repeated job records that arrive within the watermark."""
    return log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def drift_alerts(windows: DataFrame, limit: float = DEFAULTS["drift_limit"], keys: tuple[str, ...] = ()) -> DataFrame:
    """Finished windows against the one before them, within each key.

    The order is over windows, of which there is one per day and key, not over jobs.
    """
    before = Window.partitionBy(*keys).orderBy("window_start")

    def rise(name: str) -> Column:
        return F.bround(F.col(name) - F.lag(name).over(before), 4)

    return windows.select(
        *keys,
        "window_start",
        "n",
        rise("flag_rate").alias("delta_flag_rate"),
        rise("qa_fail_rate").alias("delta_qa_fail_rate"),
    ).withColumn(
        "alert",
        (F.coalesce("delta_flag_rate", F.lit(0.0)) > limit) | (F.coalesce("delta_qa_fail_rate", F.lit(0.0)) > limit),
    )


def store_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all data available now to Parquet, exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def alert_stream(
    windows: DataFrame,
    store: str,
    alerts: str,
    checkpoint: str,
    limit: float = DEFAULTS["drift_limit"],
    keys: tuple[str, ...] = (),
) -> StreamingQuery:
    """Compare finished windows with the last one before them and append the alerts.

    The state is one row per key, the last window so far. A batch reads the state of
    the batch before it and writes its own, both in folders named by the batch, so
    a batch that is run again after a failure reads and writes the same; older
    states are not read again.
    """
    cols = [*keys, "window_start", "n", "flag_rate", "qa_fail_rate"]

    def compare(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.select(*cols).write.mode("overwrite").parquet(f"{store}/windows/batch={batch_id}")
        # Read back what was written, so that the windows are not computed twice.
        fresh = spark.read.schema(batch.select(*cols).schema).parquet(f"{store}/windows/batch={batch_id}")
        last = fresh.limit(0)
        if batch_id > 0 and path_exists(spark, f"{store}/last/batch={batch_id - 1}"):
            last = spark.read.schema(fresh.schema).parquet(f"{store}/last/batch={batch_id - 1}")
        both = last.unionByName(fresh)
        newest = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), "window_start").alias("w")).filter("w IS NOT NULL")
        newest.select("w.*").write.mode("overwrite").parquet(f"{store}/last/batch={batch_id}")
        known = [*keys, "window_start"]
        found = drift_alerts(both, limit, keys).join(fresh.select(*known), known, "left_semi")
        found.write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")

    return (
        windows.writeStream.foreachBatch(compare)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
