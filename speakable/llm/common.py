"""Helpers that the operators share: words, folds, scratch tables, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import scratch_dir

#: The characters that separate words; the same six that ``bytes.split()`` takes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that one vectorised step holds in a Python worker at once.
STEP_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; null ids fall to fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return scratch_dir(spark).rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def in_few_parts(df: DataFrame) -> DataFrame:
    """An eighth of the partitions of a shuffle, for rows far smaller than those it was sized for.

    Small files cost more than their bytes, on every file system.
    """
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def stored(df: DataFrame, what: str, few: bool = True) -> DataFrame:
    """Write a table to the shared folder and read it back; this cuts the lineage.

    ``few`` writes it in few parts, as suits the slim tables that operators keep.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    (in_few_parts(df) if few else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).split(":", 1)[-1]
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sample_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, the same ones for the same ids wherever they are stored."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def one_text_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One text per key, that with the smallest hash: ids that repeat must not widen a bounded sample."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def steps(texts: Iterable[str | None], most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a batch into runs of whole texts of about ``most`` bytes, as UTF-8; null is empty."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(data) > most:
            yield first, run
            first, size, run = i, 0, []
        run.append(data)
        size += len(data)
    if run:
        yield first, run
