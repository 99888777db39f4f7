"""Writing splits, reports, manifests, logs and subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairs import signature
from ..operators.prefix import running_sum
from ..operators.timeline import marker_header
from .files import write_files
from .readers import path_exists

#: Log times keep their microseconds.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
SPLITS = ["train", "val", "test", "hard"]
_SIGNATURE = "source string, real string, train int, val int, test int, hard int, seed int"


def write_splits(splits: DataFrame, path: str, **sizes) -> None:
    """One JSON folder per split and the signature beside them."""
    splits.write.mode("overwrite").partitionBy("split").json(f"{path}/splits")
    signature(splits.sparkSession, **sizes).write.mode("overwrite").json(f"{path}/signature")


def cached_splits(spark: SparkSession, path: str, build, schema, n_train: int, seed: int, **sizes) -> DataFrame:
    """Reuse written splits if all four exist and seed and train size agree, else build them.

    The other sizes are not compared.
    """
    ready = all(path_exists(spark, f"{path}/splits/split={s}") for s in SPLITS)
    if ready and path_exists(spark, f"{path}/signature"):
        record = spark.read.schema(_SIGNATURE).json(f"{path}/signature").first()
        if record and (record["seed"], record["train"]) == (seed, n_train):
            return spark.read.schema(schema).json(f"{path}/splits")
    write_splits(build(), path, n_train=n_train, seed=seed, **sizes)
    return spark.read.schema(schema).json(f"{path}/splits")


def report_rows(df: DataFrame, kind: str, ts) -> DataFrame:
    """Rows of a report as JSON payloads under a kind and a time."""
    return df.select(
        F.lit(kind).alias("kind"), F.lit(ts).cast("timestamp").alias("ts"), F.to_json(F.struct("*")).alias("payload")
    )


def write_report(df: DataFrame, path: str, kind: str, ts) -> None:
    report_rows(df, kind, ts).write.mode("append").partitionBy("kind").json(path)


def manifest_lines(jobs: DataFrame, segments: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """Nested manifests as lines: a job's fields, its segments one per line, and the end.

    Lines, not one value per document: a manifest is as long as its document.
    Joined in the order of ``position`` they are one JSON object.
    """
    fields = [c for c in jobs.columns]
    head = F.concat(F.regexp_replace(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(',"segments":['))
    placed = running_sum(segments, [doc], order, F.lit(1), "_place", inclusive=True)
    comma = F.when(F.col("_place") > 1, ",").otherwise("")
    body = F.concat(comma, F.to_json(F.struct(*[c for c in segments.columns if c != doc]), {"ignoreNullFields": "false"}))
    last = F.lit((1 << 63) - 1)
    return (
        jobs.select(doc, F.lit(0).cast("long").alias("position"), head.alias("line"))
        .unionByName(placed.select(doc, F.col("_place").alias("position"), body.alias("line")))
        .unionByName(jobs.select(doc, last.alias("position"), F.lit("]}").alias("line")))
    )


def write_manifests(jobs: DataFrame, segments: DataFrame, path: str, doc: str, order: list[str]) -> None:
    """One JSON file per document."""
    lines = manifest_lines(jobs, segments, doc, order)
    write_files(lines, path, ".json", F.col(doc), F.col("position"), F.col("line"))


def log_rows(jobs: DataFrame) -> DataFrame:
    """Job records in log form."""
    return jobs.select(
        "ts", F.lit("job").alias("event"), "filename", "status", "n_segments", "n_flagged", "metrics"
    )


def append_job_log(jobs: DataFrame, path: str) -> None:
    log_rows(jobs).write.mode("append").option("timestampFormat", STAMP).option("timestampNTZFormat", STAMP).json(path)


def write_subtitles(cues: DataFrame, path: str, doc: str = "doc_id", fmt: str = "srt") -> None:
    """One subtitle file per document."""
    write_files(cues, path, f".{fmt}", F.col(doc), F.col("cue_no"), F.col("cue"))


def write_chapter_metadata(books: DataFrame, markers: DataFrame, path: str, doc: str = "doc_id") -> None:
    """One marker file per document of ``books`` (doc, title, author): the header, then its chapters."""
    header = books.select(doc, F.lit(-1).cast("long").alias("chapter_no"), marker_header(F.col("title"), F.col("author")).alias("marker"))
    lines = header.unionByName(markers.select(doc, F.col("chapter_no").cast("long").alias("chapter_no"), "marker"))
    write_files(lines, path, ".ffmeta", F.col(doc), F.col("chapter_no"), F.col("marker"))
