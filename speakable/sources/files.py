"""One file per document, and fingerprints of what was read or written.

``one_file`` is a writer of the Python data source API. Rows (name, suffix, position, line)
of a name and suffix stand together and in order; a task streams them into one file per
name and suffix in a folder of its own. Only the commit moves the folders of the tasks that
counted to their place, so what a failed or repeated task wrote is never seen. A
file is as long as its document, but no task holds more than a line.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "one_file"
_SCHEMA = "name string, suffix string, position long, line string"


#: File names of a null and of an empty name; no other name is escaped to them.
_NULL, _EMPTY = "%00", "%01"


def file_name(name: str | None) -> str:
    """A document's name as a file name; every character but letters, digits, ``_.-~`` is escaped.

    So is a first ``_`` or ``.``, which would hide the file from readers.
    """
    if not name:
        return _NULL if name is None else _EMPTY
    plain = quote(name, safe="")
    return plain if plain[0] not in "_." else f"%{ord(plain[0]):02X}{plain[1:]}"


@dataclass
class Folder(WriterCommitMessage):
    """What a task wrote: its folder, or None without rows."""

    name: str | None


class OneFileWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.job = uuid.uuid4().hex

    def _place(self, *parts: str):
        """File system and path below the target."""
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, "/".join((base.rstrip("/"), *parts))

    def write(self, iterator: Iterator[T.Row]) -> Folder:
        folder, out, now = f"part-{uuid.uuid4().hex}", None, None
        system, at = self._place(f".{self.job}", folder)
        for row in iterator:
            own = row["suffix"] if "suffix" in row else self.suffix
            if out is None or (row["name"], own) != now:
                if out is not None:
                    out.close()
                else:
                    system.create_dir(at, recursive=True)
                now = row["name"], own
                out = system.open_output_stream(f"{at}/{file_name(row['name'])}{own}")
            out.write((row["line"] + "\n").encode())
        if out is None:
            return Folder(None)
        out.close()
        return Folder(folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Move each task's folder to its place: one move per task, however many files it holds."""
        system, base = self._place()
        from pyarrow import fs

        system.create_dir(base, recursive=True)
        if self.overwrite:
            for found in system.get_file_info(fs.FileSelector(base)):
                if found.base_name.startswith("part-"):
                    system.delete_dir(found.path)
        for message in messages:
            if message is not None and message.name:
                system.move(f"{base}/.{self.job}/{message.name}", f"{base}/{message.name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, place = self._place(f".{self.job}")
        if system.get_file_info(place).type != fs.FileType.NotFound:
            system.delete_dir(place)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


def write_files(lines: DataFrame, path: str, suffix: str | Column, name: Column, position: Column, line: Column) -> None:
    """Write one file per name and suffix below ``path``, its lines by position; replaces what was written there before."""
    spark = lines.sparkSession
    spark.dataSource.register(OneFile)
    kind = F.lit(suffix) if isinstance(suffix, str) else suffix
    rows = lines.select(name.cast("string").alias("name"), kind.alias("suffix"), position.cast("long").alias("position"), line.alias("line"))
    rows.repartition("name").sortWithinPartitions("name", "suffix", "position").write.format(FORMAT).mode("overwrite").save(path)


def small_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path, in no more tasks than a shuffle has; a scan alone would start one for every 32 small files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: name (without folder and last suffix), suffix and content."""
    found = small_files(spark, path)
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    plain = F.regexp_replace(file, r"\.[^.]*$", "")
    name = F.when(plain == _EMPTY, "").when(plain != _NULL, F.url_decode(plain))
    return found.select(name.alias("name"), F.regexp_extract(file, r"(\.[^.]*)$", 1).alias("suffix"), "content")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a path, from its bytes: path, length, input_sha256."""
    found = small_files(spark, path)
    return found.select("path", "length", F.sha2("content", 256).alias("input_sha256"))


def rows_fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """One SHA-256 for all rows, whatever their order and however many files they lie in.

    Rows are hashed field by field, lengths included; each digest counts as
    four numbers of 60 bits whose sums, with the number of rows, are hashed again.
    Sums are combined before the shuffle. Columns count in the order of their names.
    """
    names = sorted(c for c in df.columns if c not in keys)

    def field(c: str) -> Column:
        value = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    digest = F.sha2(F.concat(*map(field, names)).cast("binary"), 256)
    hashed = df.select(*keys, digest.alias("_d"))
    lanes = [F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_l{i}") for i in range(4)]
    sums = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *lanes)
    joined = F.concat_ws(",", "n_rows", *(F.coalesce(F.col(f"_l{i}"), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)))
    return sums.select(*keys, "n_rows", F.sha2(joined.cast("binary"), 256).alias("input_sha256"))
