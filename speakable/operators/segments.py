"""Blocks to chapters and segments.

Two routes give the same result. A document that lives in one text cell is
chaptered inside its row: nothing is shuffled. Blocks that already are rows
are chaptered with windows over buckets of each document (see ``prefix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let, strip
from ..functions.segmenting import MAX_CHARS, MIN_CHARS, chunks, classify, opens_chapter
from .prefix import BEFORE, BUCKET_ROWS, SO_FAR

FIRST_TITLE = "Chapter 1"
TITLE_CHARS = 80
_SEGMENTS = "array<struct<kind:string,text:string>>"


def _segment(kind: Column | str, text: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.alias("kind"), text.alias("text"))


def block_segments(text: Column, kind: Column, max_chars: int, min_chars: int) -> Column:
    """Segments of one block: none, the heading itself, or chunks classified on their own."""
    pieces = F.transform(chunks(text, max_chars, min_chars), lambda c: _segment(classify(c), c))
    return (
        F.when(kind == "skippable", F.array().cast(_SEGMENTS))
        .when(kind == "heading", F.array(_segment("heading", text)))
        .otherwise(pieces)
    )


def book(blocks: Column, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Column:
    """``array<struct<chapter_index, title, segments>>`` of an array of blocks.

    One fold keeps scalars and appends only where a chapter opens; the
    segments of all blocks are flattened once and sliced by chapter.
    """

    def describe(block: Column) -> Column:
        def with_kind(text: Column) -> Column:
            start = block["is_heading"] | opens_chapter(text)
            return let(
                F.struct(start.alias("start"), classify(text, start).alias("kind")),
                lambda k: F.struct(
                    F.substr(text, F.lit(1), F.lit(TITLE_CHARS)).alias("title"),
                    k["start"].alias("start"),
                    k["kind"].alias("kind"),
                    block_segments(text, k["kind"], max_chars, min_chars).alias("segments"),
                ),
            )

        return let(strip(block["text"]), with_kind)

    def chapters(info: Column) -> Column:
        done = F.array().cast("array<struct<first:int,title:string>>")
        state = F.struct(
            F.lit(0).alias("count"),
            F.lit(0).alias("last"),
            F.lit(0).alias("first"),
            F.lit(FIRST_TITLE).alias("title"),
            done.alias("done"),
        )

        def step(acc: Column, b: Column) -> Column:
            opens = b["start"] & (acc["count"] > acc["last"])
            first = F.when(opens, acc["count"]).otherwise(acc["first"])
            title = F.when(opens, b["title"]).otherwise(acc["title"])
            renamed = (b["kind"] == "heading") & (first == acc["count"]) & F.startswith(title, F.lit("Chapter "))
            finished = F.struct(acc["first"].alias("first"), acc["title"].alias("title"))
            return F.struct(
                (acc["count"] + F.size(b["segments"])).alias("count"),
                F.when(b["start"], acc["count"]).otherwise(acc["last"]).alias("last"),
                first.alias("first"),
                F.when(renamed, b["title"]).otherwise(title).alias("title"),
                F.when(opens, F.array_append(acc["done"], finished)).otherwise(acc["done"]).alias("done"),
            )

        def finish(acc: Column) -> Column:
            tail = F.struct(acc["first"].alias("first"), acc["title"].alias("title"))
            return (
                F.when(acc["count"] > acc["first"], F.array_append(acc["done"], tail))
                .when(
                    F.size(acc["done"]) == 0,
                    F.array_append(
                        acc["done"], F.struct(F.lit(0).alias("first"), F.lit(FIRST_TITLE).alias("title"))
                    ),
                )
                .otherwise(acc["done"])
            )

        marks = F.aggregate(info, state, step, finish)
        segments = F.flatten(F.transform(info, lambda b: b["segments"]))

        def cut(both: Column) -> Column:
            return F.transform(
                both["marks"],
                lambda m, k: F.struct(
                    k.alias("chapter_index"),
                    m["title"].alias("title"),
                    F.slice(
                        both["segments"],
                        m["first"] + 1,
                        F.coalesce(F.get(both["marks"], k + 1)["first"], F.size(both["segments"])) - m["first"],
                    ).alias("segments"),
                ),
            )

        return let(F.struct(marks.alias("marks"), segments.alias("segments")), cut)

    visible = F.filter(blocks, lambda b: strip(b["text"]) != "")
    return let(F.transform(visible, describe), chapters)


def chapters(df: DataFrame, blocks: Column, *keys: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per chapter of documents whose blocks are an array; map-only."""
    return df.select(*keys, F.inline(book(blocks, max_chars, min_chars))).select(
        *keys, "chapter_index", "title", F.size("segments").alias("n_segments")
    )


def segments(df: DataFrame, blocks: Column, *keys: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per segment of documents whose blocks are an array; map-only."""
    return (
        df.select(*keys, F.explode(book(blocks, max_chars, min_chars)).alias("chapter"))
        .select(*keys, "chapter.chapter_index", F.posexplode("chapter.segments").alias("seg_order", "segment"))
        .select(*keys, "chapter_index", "seg_order", "segment.kind", "segment.text")
    )


def assign_chapters(
    blocks: DataFrame, doc: str, pos: str, count: str, start: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``opens``, ``chapter_index`` and ``first_order`` to block rows.

    A possible start opens a chapter exactly when segments appeared since the
    previous possible start. Only the first possible start of a bucket depends
    on earlier buckets, so one summary row per bucket settles everything.
    """
    group = [doc, "_bucket"]
    local = Window.partitionBy(*group).orderBy(pos)
    n = F.col(count)
    rows = (
        blocks.withColumn("_bucket", F.floor(F.col(pos) / bucket_rows))
        .withColumn("_cum", F.coalesce(F.sum(n).over(local.rowsBetween(*BEFORE)), F.lit(0)))
        .withColumn("_prev", F.max(F.when(F.col(start), F.col("_cum"))).over(local.rowsBetween(*BEFORE)))
        .withColumn("_opens", F.col(start) & F.coalesce(F.col("_cum") > F.col("_prev"), F.lit(False)))
        .withColumn("_first", F.col(start) & F.col("_prev").isNull())
    )
    summary = rows.groupBy(*group).agg(
        F.sum(n).alias("_sum"),
        F.count_if("_opens").alias("_n_opens"),
        F.min(F.when(F.col("_first"), F.col("_cum"))).alias("_first_cum"),
        F.max(F.when(F.col(start), F.col("_cum"))).alias("_last_cum"),
        F.max(F.when(F.col("_opens"), F.col("_cum"))).alias("_last_open"),
    )
    outer = Window.partitionBy(doc).orderBy("_bucket").rowsBetween(*BEFORE)
    carry = (
        summary.withColumn("_base", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
        .withColumn("_before", F.coalesce(F.max(F.col("_base") + F.col("_last_cum")).over(outer), F.lit(0)))
        .withColumn(
            "_first_opens", F.coalesce(F.col("_base") + F.col("_first_cum") > F.col("_before"), F.lit(False))
        )
        .withColumn(
            "_chapters",
            F.coalesce(F.sum(F.col("_n_opens") + F.col("_first_opens").cast("int")).over(outer), F.lit(0)),
        )
        .withColumn(
            "_start",
            F.coalesce(
                F.max(
                    F.col("_base")
                    + F.greatest(F.col("_last_open"), F.when(F.col("_first_opens"), F.col("_first_cum")))
                ).over(outer),
                F.lit(0),
            ),
        )
        .select(*group, "_base", "_first_opens", "_chapters", "_start")
    )
    so_far = local.rowsBetween(*SO_FAR)
    cum = F.col("_base") + F.col("_cum")
    return (
        rows.join(carry, group)
        .withColumn("opens", F.col("_opens") | (F.col("_first") & F.col("_first_opens")))
        .withColumn("chapter_index", F.col("_chapters") + F.count_if("opens").over(so_far))
        .withColumn(
            "first_order",
            cum - F.greatest(F.col("_start"), F.max(F.when(F.col("opens"), cum)).over(so_far)),
        )
        .select(*blocks.columns, "opens", "chapter_index", "first_order")
    )


def block_rows(
    blocks: DataFrame, doc: str = "doc_id", pos: str = "block_pos",
    max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Block rows with kind, segments and their place in the book."""
    described = (
        blocks.withColumn("text", strip(F.col("text")))
        .filter(F.col("text") != "")
        .withColumn("start", F.col("is_heading") | opens_chapter(F.col("text")))
        .withColumn("kind", classify(F.col("text"), F.col("start")))
        .withColumn("pieces", block_segments(F.col("text"), F.col("kind"), max_chars, min_chars))
        .withColumn("n_pieces", F.size("pieces"))
    )
    return assign_chapters(described, doc, pos, "n_pieces", "start", bucket_rows)


def segments_of_rows(blocks: DataFrame, doc: str = "doc_id", pos: str = "block_pos", **sizes) -> DataFrame:
    """One row per segment of documents whose blocks are rows."""
    placed = block_rows(blocks, doc, pos, **sizes)
    return placed.select(
        doc, "chapter_index", "first_order", F.posexplode("pieces").alias("at", "segment")
    ).select(
        doc,
        "chapter_index",
        (F.col("first_order") + F.col("at")).alias("seg_order"),
        "segment.kind",
        "segment.text",
    )


def chapters_of_rows(blocks: DataFrame, doc: str = "doc_id", pos: str = "block_pos", **sizes) -> DataFrame:
    """One row per chapter with its title; a document without segments has one empty chapter."""
    placed = block_rows(blocks, doc, pos, **sizes)
    cut = F.substr("text", F.lit(1), F.lit(TITLE_CHARS))
    first_heading = (F.col("first_order") == 0) & (F.col("kind") == "heading")
    found = (
        placed.groupBy(doc, "chapter_index")
        .agg(
            F.max(F.when(F.col("opens"), cut)).alias("opener"),
            F.max(F.when(first_heading, cut)).alias("renamed"),
            F.sum("n_pieces").alias("n_segments"),
        )
        .filter(F.col("n_segments") > 0)
    )
    opener = F.coalesce(F.col("opener"), F.lit(FIRST_TITLE))
    titled = found.select(
        doc,
        "chapter_index",
        F.when(F.startswith(opener, F.lit("Chapter ")), F.coalesce("renamed", opener)).otherwise(opener).alias("title"),
        "n_segments",
    )
    return (
        blocks.select(doc)
        .distinct()
        .join(titled, doc, "left")
        .select(
            doc,
            F.coalesce("chapter_index", F.lit(0)).alias("chapter_index"),
            F.coalesce("title", F.lit(FIRST_TITLE)).alias("title"),
            F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
        )
    )
