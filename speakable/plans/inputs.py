"""The driver's tables and the dense inputs derived from them.

The prose tables hold few numbers, so the number, money, time and date
operators read texts that Spark writes from the star schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"\n"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a table dealt out evenly to as many tasks as a shuffle has.

    A row group of a file cannot be split, however large it is, and text work
    runs at a hundredth of the speed of a shuffle; so its few columns are always
    dealt out first.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def number_text(value: Column) -> Column:
    """Integer text of a whole number held as a double."""
    return value.cast("bigint").cast("string")


def cents_text(value: Column) -> Column:
    """Two-place text of a price: whole cents first, so no rounding is left to printing."""
    cents = F.round(F.abs(value) * 100).cast("bigint")
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )


def grouped_cents(value: Column) -> Column:
    cents = F.round(F.abs(value) * 100).cast("bigint")
    return F.concat(F.format_number(F.floor(cents / 100), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with one integer key."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "line_id", F.col("l_orderkey") * 8 + F.col("l_linenumber")
    )


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for generated pairs: one per order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written sentence per order, dense in spans."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("segment_id"),
        F.concat(
            F.lit("Order "), F.col("o_orderkey").cast("string"),
            F.lit(" of "), F.date_format("o_orderdate", "MMMM d, yyyy"),
            F.lit(" cost $"), grouped_cents(F.col("o_totalprice")),
            F.lit("; Dr. "), F.col("o_custkey").cast("string"),
            F.lit(" paid "), (F.col("o_custkey") % 100).cast("string"), F.lit("% at "),
            (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit(":"),
            F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lit(" PM, Chapter IV."),
        ).alias("text"),
    )


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as block rows: a system turn or the first one is a heading."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("block_pos"),
        F.col("text"),
        ((F.col("role") == "system") | (F.col("turn") == 0)).alias("is_heading"),
    )


def talk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as segments: chapters of three turns, kinds by role."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("doc_id"),
        F.floor(F.col("turn") / 3).cast("int").alias("chapter_index"),
        (F.col("turn") % 3).cast("int").alias("seg_order"),
        F.when(F.col("role") == "system", "heading")
        .when(F.col("role") == "user", "dialogue")
        .otherwise("narration")
        .alias("kind"),
        F.col("text"),
        (F.length("text") * 60).cast("bigint").alias("duration_ms"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as clips of 64 samples at 100 Hz, ten labels as books."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").alias("doc_id"),
        F.col("vec_id").alias("seg_id"),
        F.lit(100).alias("sr"),
        F.repeat(F.lit("x"), (F.col("vec_id") % 40).cast("int")).alias("text"),
        F.col("embedding").alias("samples"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a job log: type is the status, value drives the counts."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id"),
        F.col("ts"),
        F.lit("job").alias("event"),
        F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("filename"),
        F.col("event_type").alias("status"),
        (k % 20).alias("n_segments"),
        (k % 7).alias("n_flagged"),
        F.struct(
            F.when(F.col("event_type") != "error", F.col("value")).alias("rtf"),
            F.struct(
                (k % 5).alias("pass"), (F.col("event_id") % 3).alias("fail"), F.lit(0).cast("bigint").alias("resynth_attempts")
            ).alias("audio_qa"),
        ).alias("metrics"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold, a length rule as prediction."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    gold = table(spark, sf_dir, "labels")
    return gold.join(d, "doc_id").select(
        F.col("doc_id").alias("pair_id"),
        F.col("lang").alias("slice"),
        F.when(F.col("toxic") == 1, F.array(F.lit("MONEY"), F.lit("PLAIN")))
        .when(F.col("n_chars") % 5 == 0, F.array().cast("array<string>"))
        .when(F.col("n_chars") % 2 == 0, F.array(F.lit("CARDINAL")))
        .otherwise(F.array(F.lit("ABBREV")))
        .alias("classes"),
        F.col("n_chars").cast("string").alias("before"),
        F.concat(F.lit(" quality "), F.col("quality").cast("string")).alias("after"),
        F.concat(F.lit("quality  "), F.when(F.col("n_chars") > 900, "1").otherwise("0")).alias("text"),
    )
