"""Typed spans as tables, and the rewriting of whole text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.readings import spoken
from ..functions.scanning import normalize, scan
from .prefix import durable


def spans(df: DataFrame, text: str, *keys: str, classes: list[str] | None = None) -> DataFrame:
    """One row per resolved span; texts should be segments, not whole books."""
    return df.select(*keys, F.posexplode(scan(F.col(text), classes)).alias("span_no", "span")).select(
        *keys, "span_no", "span.start", "span.stop", "span.cls", "span.surface"
    )


def span_tokens(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Surface, class and spoken form of every span."""
    return spans(df, text, *keys).withColumn("spoken", spoken(F.col("cls"), F.col("surface")))


def normalized(df: DataFrame, text: str = "text", out: str = "normalized") -> DataFrame:
    """Add the spoken form of a text column; stateless and map-only."""
    return df.withColumn(out, normalize(F.col(text)))


def span_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Spans per class, within the given keys."""
    return found.groupBy(*keys, "cls").agg(F.count(F.lit(1)).alias("n_spans"))


def surface_counts(found: DataFrame) -> DataFrame:
    """How often each surface occurs, written once; counted before the shuffle, so a frequent one is no hot key."""
    return durable(found.groupBy("cls", "surface").agg(F.count(F.lit(1)).alias("n")))


def lexicon(found: DataFrame) -> DataFrame:
    """Every distinct surface once, with its spoken form; ``found`` may be spans or their counts."""
    return found.select("cls", "surface").distinct().withColumn("spoken", spoken(F.col("cls"), F.col("surface")))


def join_lexicon(found: DataFrame, words: DataFrame) -> DataFrame:
    """Spoken forms from a lexicon for spans or their counts; surfaces it lacks stay as they are."""
    return found.join(words.select("cls", "surface", "spoken"), ["cls", "surface"], "left").withColumn(
        "spoken", F.coalesce("spoken", "surface")
    )
