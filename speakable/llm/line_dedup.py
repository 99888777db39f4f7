"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a site if the share of the site's pages that contain
it exceeds a ratio. Pages count once per distinct line, so the counts
combine before the shuffle and no list of pages is ever gathered. At most
(distinct lines per page) / ratio lines of a site can exceed the ratio, so the
table of boilerplate is small; it is broadcast only if its counted rows are
below ``broadcast_rows``, and otherwise joined line by line.

Defined cases: a null text stays null and has no lines; an empty text has one
blank line; blank lines are never boilerplate; pages with a null site form a site of
their own; a site needs ``min_pages`` pages with the line, so that a site of one page
keeps its lines; all copies of a boilerplate line go, repeats within a page
included; a page that loses every line keeps an empty text; repeated rows count as
pages of their own; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATIO, MIN_PAGES = 0.05, 3
BLANK = r"^[\x20\x09-\x0D]*$"
BREAK = r"\n"


def _digest(line: Column) -> Column:
    """128 bits of a line: two hashes that differ in what they read."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("line"), line).alias("g"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(site, h, g) of each boilerplate line; ``pages`` has site and text."""
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    lines = pages.select("site", F.explode(F.array_distinct(F.split("text", BREAK))).alias("line")).filter(~F.col("line").rlike(BLANK))
    seen = lines.select("site", _digest(F.col("line")).alias("d")).groupBy("site", "d.h", "d.g").agg(F.count(F.lit(1)).alias("n"))
    often = seen.filter(F.col("n") >= min_pages)
    total = totals.select(F.col("site").alias("total_site"), "n_pages")
    return often.join(total, F.col("site").eqNullSafe(F.col("total_site"))).filter(F.col("n") > ratio * F.col("n_pages")).select("site", "h", "g")


def drop_boilerplate(
    docs: DataFrame,
    site_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """(row, n_lines, n_dropped, text): the row as a struct, its counts, and the text without boilerplate."""
    pages = docs.select(F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    bad = stored(boilerplate(pages, ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct("*").alias("row"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    rows = rows.withColumn("lines", F.split("text", BREAK))
    if bad.limit(broadcast_rows + 1).count() <= broadcast_rows:
        lists = bad.groupBy("site").agg(F.collect_set(F.struct("h", "g")).alias("bad")).withColumnRenamed("site", "bad_site")
        # Counted above: at most broadcast_rows hashes in all.
        marked = rows.join(F.broadcast(lists), F.col("site").eqNullSafe(F.col("bad_site")), "left")
        keep = F.filter("lines", lambda x: F.coalesce(~F.array_contains(F.col("bad"), _digest(x)), F.lit(True)))
    else:
        marked = _marked_by_join(rows, bad)
        keep = F.filter("lines", lambda x, i: F.coalesce(~F.array_contains(F.col("gone"), i), F.lit(True)))
    return (
        marked.select("row", "text", "lines", keep.alias("kept"))
        .withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long"))
        .select("row", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
    )


def _marked_by_join(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows with the positions of their boilerplate lines, found by a join that may be skewed.

    Rows are told apart by a hash of all their values; rows equal in everything
    share their positions.
    """
    keyed = rows.withColumn("id", F.struct(F.xxhash64("row").alias("a"), F.xxhash64(F.lit("row"), "row").alias("b")))
    lines = keyed.select("id", "site", F.posexplode("lines").alias("pos", "line")).select("id", "site", "pos", _digest(F.col("line")).alias("d"))
    on = lines["site"].eqNullSafe(bad["site"]) & (lines["d.h"] == bad["h"]) & (lines["d.g"] == bad["g"])
    gone = lines.join(bad, on, "left_semi").groupBy("id").agg(F.collect_set("pos").alias("gone"))
    return keyed.join(gone, "id", "left")


def without_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """The documents with their columns, texts without boilerplate lines."""
    out = drop_boilerplate(docs, **options)
    text_col = options.get("text_col", "text")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
pages AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
seen AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines
  WHERE NOT regexp_full_match(line, '[\\x20\\x09-\\x0D]*') GROUP BY source, line),
bad AS (
  SELECT s.source, s.line FROM seen s JOIN pages p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.n >= {MIN_PAGES} AND s.n > {RATIO} * p.n_pages),
judged AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM judged GROUP BY doc_id
"""
