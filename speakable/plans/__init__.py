"""Queries over the driver's tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULES = ["text", "numbers", "corpus", "jobs", "lifecycle"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to segments to spans to spoken text, summed per language."""
    from ..functions.scanning import scan, splice
    from ..functions.readings import spoken
    from ..functions.expr import squash
    from .inputs import table
    from .text import segmented

    segs = segmented(spark, sf_dir).withColumn("spans", scan(F.col("text")))
    text = F.col("text")
    said = squash(splice(text, F.col("spans"), lambda s: spoken(s["cls"], s["surface"])))
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    per_doc = segs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(said != squash(text)).alias("n_changed"),
        F.sum(F.size("spans")).alias("n_spans"),
    )
    return (
        per_doc.join(langs, "doc_id")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.sum("n_segments").alias("n_segments"),
            F.sum("n_spans").alias("n_spans"),
            F.bround(F.sum("n_changed") / F.sum("n_segments"), 4).alias("changed_share"),
        )
    )
