"""Running sums and positions that survive one huge group.

A window over a whole document runs in one task, which fails when a single
document holds a third of all rows. Here each group is cut into buckets of
consecutive positions; buckets are summed on their own, the short table of
bucket sums is accumulated per group, and each row adds its bucket's carry to
a window inside the bucket. The result is exact and no task sees more than one
bucket of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 100_000
BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    A session that names none gets a folder beside its tables, on the file
    system of the warehouse. On a cluster that must not be a disk of one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local" and warehouse.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = warehouse.rstrip("/") + "/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def running_sum(
    df: DataFrame,
    key: list[str],
    order: list[str],
    value: Column,
    out: str,
    bucket: Column | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the same key.

    ``bucket`` must grow with ``order``; by default it cuts the last order
    column, an integer position, every ``BUCKET_ROWS``.
    """
    if bucket is None:
        cut = F.floor(F.col(order[-1]) / BUCKET_ROWS).alias("cut")
        bucket = F.struct(*order[:-1], cut)
    rows = df.withColumn("_value", value).withColumn("_bucket", bucket)
    group = [*key, "_bucket"]
    sums = rows.groupBy(*group).agg(F.sum("_value").alias("_sum"))
    outer = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(*BEFORE)
    carry = sums.select(*group, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_carry"))
    inner = Window.partitionBy(*group).orderBy(*order).rowsBetween(*(SO_FAR if inclusive else BEFORE))
    return (
        rows.join(carry, group)
        .withColumn(out, F.col("_carry") + F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .drop("_value", "_bucket", "_carry")
        .select(*df.columns, out)
    )


def number_rows(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """Number all rows from 1 in the given total order without a single-task window.

    The rows are range-partitioned by the full order, so that even equal
    leading values spread, and written once; each partition then adds the
    number of rows before it. The offsets table has one row per partition.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    low = (1 << 33) - 1
    placed = durable(
        df.repartitionByRange(parts, *[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_offset"),
    )
    # One row per shuffle partition: a proven bound, so a broadcast is safe.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_slot").bitwiseAND(low) + 1)
        .select(*df.columns, out)
    )
