"""Reading documents, pair files and job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import strip
from ..operators.blocks import document_blocks
from ..schemas import JOB_LOG, PAIRS
from .files import small_files

# Formats whose files are archives or pages, not text.
CONTAINERS = ["epub", "pdf"]


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1. A byte-order mark stays."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(text, F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with title, format, text and blocks; unknown formats are text.

    EPUB and PDF containers need a parser of their own; their unpacked tables
    go to ``html_blocks`` and ``layout_blocks``. Here they have their format, a
    null text and no blocks.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    container = suffix.isin(*CONTAINERS)
    known = suffix.isin("txt", "text", "md", "markdown", "html", "htm", "xhtml", *CONTAINERS)
    return (
        small_files(spark, path)
        .select(
            "path",
            F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "").alias("title"),
            F.when(known, suffix).otherwise("txt").alias("source_format"),
            F.when(~container, decode_text(F.col("content"))).alias("text"),
        )
        .withColumn("blocks", F.when(F.col("text").isNotNull(), document_blocks(F.col("text"), F.col("source_format"))).otherwise(F.array()))
    )


def parse_jsonl(lines: DataFrame, schema=PAIRS, column: str = "value") -> DataFrame:
    """Strict: blank lines are skipped, a bad line fails the job."""
    return (
        lines.filter(strip(F.col(column)) != "")
        .select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("row"))
        .select("row.*")
    )


def read_jsonl(spark: SparkSession, path: str, schema=PAIRS) -> DataFrame:
    return parse_jsonl(spark.read.text(path), schema)


def read_jsonl_lenient(spark: SparkSession, path: str, schema=PAIRS) -> DataFrame:
    """Rows with their ``file``; a line that does not fit has null fields and stands in ``corrupt``."""
    wide = T.StructType([*schema.fields, T.StructField("corrupt", T.StringType())])
    lines = spark.read.text(path).filter(strip(F.col("value")) != "").select("value", F.col("_metadata.file_path").alias("file"))
    row = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.select("file", row.alias("row")).select("file", "row.*")


def file_counts(rows: DataFrame) -> DataFrame:
    """Good and bad lines per file of ``read_jsonl_lenient``."""
    return rows.groupBy("file").agg(F.count_if(F.col("corrupt").isNull()).alias("n_rows"), F.count_if(F.col("corrupt").isNotNull()).alias("n_corrupt"))


def parse_log(lines: DataFrame, schema=JOB_LOG, column: str = "value") -> DataFrame:
    """Lenient: lines that are blank or not a JSON object are skipped."""
    kept = lines.filter(F.get_json_object(column, "$").isNotNull())
    return kept.select(F.from_json(column, schema).alias("row")).select("row.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def read_log(spark: SparkSession, path: str, schema=JOB_LOG) -> DataFrame:
    """Job log; a missing file is an empty log."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return parse_log(spark.read.text(path), schema)
