"""Cheap checks before the passes of the scanner and of the classifier change no result."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from speakable.functions import scanning, segmenting
from speakable.functions.expr import squash, strip
from speakable.functions.readings import spoken

PARTS = [
    "king", "Louis", "LOUIS", "xiv", "XIV", "IV", "İv", "xı", "Chapter", "Dr.", "St", "Ave.", "e.g.", "i.e", "approx.", "a@b.de", "www.x.y", "http://q/", "$", "5", "3/4",
    "1,234.5", "٣", "7th", "%", "10 km", "page", "Page 12", "12", "copyright", "Copyrights", "table of contents", "Table of contents", "prologue", "Epilogue", "“", "\"", "hi",
    "﷐", "﷑", "x" * 30, "K", "ſt", "St Main", "word", "Word", ".", "!", ",", "é", "\U0001d7d8",
]
GAPS = [" ", "  ", "", " ", " ", "\n", "\x85", "\x1c", "\t"]


def test_checks_change_nothing(spark):
    rng = random.Random(17)
    rows = [("".join(rng.choice(PARTS) + rng.choice(GAPS) for _ in range(rng.randrange(1, 6))),) for _ in range(3000)] + [("",), (None,)]
    t = F.col("text")
    whole = squash(scanning.splice(t, scanning.scan(t), lambda s: spoken(s["cls"], s["surface"])))
    drops = F.lit(False)
    for pattern in segmenting.DROP_PATTERNS:
        drops = drops | F.rlike(strip(t), F.lit(pattern))
    rules = [scanning.Rule(r.cls, r.pattern, False) for r in scanning.RULES]
    unchecked = scanning.scan(t, rules=rules)
    found = spark.createDataFrame(rows, "text string").select(
        t,
        scanning.normalize(t).eqNullSafe(whole).alias("said"),
        (F.size(unchecked) == 0).alias("none"),
        scanning.scan(t).eqNullSafe(unchecked).alias("scanned"),
        scanning._may_match(t).alias("may"),
        segmenting.is_boilerplate(t).eqNullSafe(drops).alias("dropped"),
        segmenting.opens_chapter(t).eqNullSafe(F.rlike(strip(t), F.lit(segmenting.CHAPTER_PATTERN))).alias("opens"),
    )
    seen = found.collect()
    for r in seen:
        assert r.said and r.dropped and r.opens, r
        if r.text is not None:
            assert r.scanned and (r.may or r.none), r
    assert sum(r.none is True and not r.may for r in seen) > 100 and sum(r.none is False for r in seen) > 1000


def test_stream_deals_out_a_table_of_one_file(spark):
    """Its one row group would else be one task, however large."""
    from speakable.plans import jobs

    said = jobs.stream_normalize(spark, "/root/testdata/sf0.001")
    assert len(said.inputFiles()) > 1
