"""Start and end times, chapter spans, subtitles and chapter markers.

All times are whole milliseconds, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import strip
from ..schemas import DEFAULTS
from .prefix import BEFORE, BUCKET_ROWS, SO_FAR, running_sum

RANGE_CHAPTERS = 10_000


def timeline(
    segments: DataFrame,
    doc: str = "doc_id",
    sentence_gap: int = DEFAULTS["sentence_gap_ms"],
    paragraph_gap: int = DEFAULTS["paragraph_gap_ms"],
    chapter_gap: int = DEFAULTS["chapter_gap_ms"],
    bucket_rows: int = BUCKET_ROWS,
    number_cues: bool = False,
    range_chapters: int = RANGE_CHAPTERS,
) -> DataFrame:
    """Add ``start_ms``, ``end_ms`` and the dense ``chapter_no`` to segments with ``duration_ms``.

    Each bucket of a chapter is summed with a gap after every segment; the
    table of buckets then takes back the gap after a chapter's last segment
    and adds the one between chapters. Buckets are summed by ranges of
    ``range_chapters`` chapters. With ``number_cues`` spoken segments
    also get their ``cue_no`` in the same pass.
    """
    rows = (
        segments.withColumn("_cut", F.floor(F.col("seg_order") / bucket_rows))
        .withColumn("_gap", F.when(F.col("kind") == "heading", paragraph_gap).otherwise(sentence_gap))
        .withColumn("_step", F.col("duration_ms") + F.col("_gap"))
        .withColumn("_cue", is_cue().cast("bigint") if number_cues else F.lit(0).cast("bigint"))
    )
    group = [doc, "chapter_index", "_cut"]
    buckets = rows.groupBy(*group).agg(
        F.sum("_step").alias("_sum"), F.max_by("_gap", "seg_order").alias("_last_gap"), F.sum("_cue").alias("_cues")
    )
    # From here one row per bucket, never one per segment. Chapters are summed by ranges,
    # so a document of very many chapters is no single window.
    sum_over = lambda value, over: F.coalesce(F.sum(value).over(over.rowsBetween(*BEFORE)), F.lit(0))
    in_chapter = Window.partitionBy(doc, "chapter_index").orderBy("_cut")
    buckets = buckets.withColumn("_in", sum_over("_sum", in_chapter)).withColumn("_cues_in", sum_over("_cues", in_chapter))
    # The gap behind the last chapter is added as well; nothing comes after it.
    chapters = buckets.groupBy(doc, "chapter_index").agg(
        (F.sum("_sum") - F.max_by("_last_gap", "_cut") + chapter_gap).alias("_total"), F.sum("_cues").alias("_all_cues"), F.lit(1).cast("bigint").alias("_one")
    )
    chapters = chapters.withColumn("_range", F.floor(F.col("chapter_index") / range_chapters))
    values = ["_total", "_all_cues", "_one"]
    in_book, in_range = Window.partitionBy(doc).orderBy("_range"), Window.partitionBy(doc, "_range").orderBy("chapter_index")
    ranges = chapters.groupBy(doc, "_range").agg(*(F.sum(v).alias(v) for v in values))
    ranges = ranges.select(doc, "_range", *(sum_over(v, in_book).alias(f"{v}_before") for v in values))
    chapters = chapters.join(ranges, [doc, "_range"]).select(doc, "chapter_index", *((F.col(f"{v}_before") + sum_over(v, in_range)).alias(v) for v in values))
    carry = buckets.join(chapters, [doc, "chapter_index"]).select(
        *group, (F.col("_total") + F.col("_in")).alias("_base"), (F.col("_all_cues") + F.col("_cues_in")).alias("_cue_base"), F.col("_one").alias("chapter_no")
    )
    inner = Window.partitionBy(*group).orderBy("seg_order")
    timed = (
        rows.join(carry, group)
        .withColumn("start_ms", F.col("_base") + F.coalesce(F.sum("_step").over(inner.rowsBetween(*BEFORE)), F.lit(0)))
        .withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))
    )
    columns = [*segments.columns, "chapter_no", "start_ms", "end_ms"]
    if number_cues:
        timed = timed.withColumn("cue_no", F.col("_cue_base") + F.sum("_cue").over(inner.rowsBetween(*SO_FAR)))
        columns.append("cue_no")
    return timed.select(*columns)


def is_cue() -> Column:
    """Segments that get a subtitle: spoken and not blank."""
    return (F.col("kind") != "skippable") & (strip(F.col("text")) != "")


def chapter_spans(timed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """First start and last end of each chapter, with its own index and its dense number."""
    return timed.groupBy(doc, "chapter_index").agg(
        F.min("chapter_no").alias("chapter_no"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )


def join_chapter_title(spans: DataFrame, titles: DataFrame, doc: str = "doc_id", index: str = "chapter_index") -> DataFrame:
    """Titles by chapter, with the default name where there is none."""
    default = F.concat(F.lit("Chapter "), (F.col(index) + 1).cast("string"))
    return spans.join(titles.select(doc, index, "title"), [doc, index], "left").withColumn(
        "title", F.coalesce("title", default)
    )


def timestamp_text(ms: Column, vtt: bool = False) -> Column:
    """``HH:MM:SS,mmm``; negative times are zero and milliseconds always carry over."""
    t = F.greatest(F.lit(0), ms).cast("bigint")

    def unit(size: int, wrap: int | None = None) -> Column:
        value = (t - F.pmod(t, F.lit(size))) / size
        return (value if wrap is None else F.pmod(value, F.lit(wrap))).cast("bigint")

    shape = "%02d:%02d:%02d" + ("." if vtt else ",") + "%03d"
    return F.format_string(shape, unit(3_600_000), unit(60_000, 60), unit(1000, 60), F.pmod(t, F.lit(1000)))


def cues(timed: DataFrame, doc: str = "doc_id", fmt: str = "srt") -> DataFrame:
    """Numbered subtitle cues as rows; written in order they are the file.

    Rows, not one text per document: a file is as long as its book.
    """
    kept = timed.filter(is_cue()).withColumn("text", strip(F.col("text")))
    if "cue_no" not in kept.columns:
        kept = running_sum(kept, [doc], ["chapter_index", "seg_order"], F.lit(1), "cue_no", inclusive=True)
    vtt = fmt == "vtt"
    times = F.concat(
        timestamp_text(F.col("start_ms"), vtt), F.lit(" --> "), timestamp_text(F.col("end_ms"), vtt)
    )
    head = F.lit("WEBVTT\n\n") if vtt else F.lit("")
    number = F.lit("") if vtt else F.concat(F.col("cue_no").cast("string"), F.lit("\n"))
    body = F.concat(number, times, F.lit("\n"), F.col("text"), F.lit("\n"))
    return kept.select(
        doc, "cue_no", F.concat(F.when(F.col("cue_no") == 1, head).otherwise(""), body).alias("cue")
    )


def chapter_markers(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Marker text of each chapter as a row, ordered by ``chapter_no``."""
    line = F.concat_ws(
        "\n",
        F.lit("[CHAPTER]"),
        F.lit("TIMEBASE=1/1000"),
        F.concat(F.lit("START="), F.col("start_ms").cast("string")),
        F.concat(F.lit("END="), F.col("end_ms").cast("string")),
        F.concat(F.lit("title="), F.col("title")),
    )
    return spans.select(doc, "chapter_no", line.alias("marker"))


def marker_header(title: Column, author: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit(";FFMETADATA1"),
        F.concat(F.lit("title="), title),
        F.concat(F.lit("artist="), author),
        F.concat(F.lit("album="), title),
    )


def group_clips(clips: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Spoken clips in chapter order with their position in the chapter, as rows."""
    spoken = clips.filter(F.col("kind") != "skippable")
    return running_sum(spoken, [doc, "chapter_index"], ["seg_order"], F.lit(1), "clip_no", inclusive=True)
