"""Exact-match scores, per-class accuracy and error tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import squash

# Classes whose misreading changes a quantity.
NUMERIC_CLASSES = [
    "CARDINAL", "DECIMAL", "MONEY", "MEASURE", "DATE", "TIME", "TELEPHONE", "ORDINAL", "FRACTION", "ROMAN",
]


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    """Rounded share, half to even; nothing of nothing is 0."""
    return F.bround(part / F.greatest(F.lit(1), whole), places)


def join_pred_gold(pairs: DataFrame, predictions: DataFrame, key: str = "pair_id") -> DataFrame:
    """Gold pairs beside a model's text, with the exact-match flag."""
    joined = pairs.join(predictions.select(key, F.col("text").alias("pred")), key)
    return joined.withColumn("correct", squash(F.col("after")) == squash(F.col("pred")))


def _labels() -> Column:
    """Classes of a pair; one without classes counts as PLAIN."""
    none = F.coalesce(F.size("classes"), F.lit(0)) <= 0
    return F.when(none, F.array(F.lit("PLAIN"))).otherwise(F.col("classes"))


def exploded_classes(scored: DataFrame) -> DataFrame:
    """One row per class of a pair."""
    return scored.withColumn("cls", F.explode(_labels()))


def class_scores(scored: DataFrame, *keys: str) -> DataFrame:
    """n, errors and accuracy per class."""
    return (
        exploded_classes(scored)
        .groupBy(*keys, "cls")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("correct")).alias("errors"))
        .withColumn("accuracy", ratio(F.col("n") - F.col("errors"), F.col("n")))
    )


def score(scored: DataFrame, *keys: str) -> DataFrame:
    """Sentence accuracy and the mean of the rounded class accuracies, in one pass over the rows.

    A null label beside a row's classes stands for the sentence as a whole.
    """
    labels = F.concat(F.array(F.lit(None).cast("string")), _labels())
    counted = (
        scored.select(*keys, "correct", F.explode(labels).alias("cls"))
        .groupBy(*keys, "cls")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    )
    whole = F.col("cls").isNull()
    accuracy = F.when(~whole, ratio(F.col("n_correct"), F.col("n")))
    return (
        counted.groupBy(*keys)
        .agg(
            F.max(F.when(whole, F.col("n"))).alias("n"),
            F.max(F.when(whole, F.col("n_correct"))).alias("n_correct"),
            F.bround(F.sum(accuracy) / F.count(accuracy), 4).alias("macro_class_accuracy"),
        )
        .withColumn("sentence_accuracy", ratio(F.col("n_correct"), F.col("n")))
    )


def compare(scores: DataFrame, model: str, baseline: str, slice_col: str = "slice") -> DataFrame:
    """Model minus baseline per slice, in one pass over the score table."""

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col(value)))

    out = scores.groupBy(slice_col).agg(
        of(model, "sentence_accuracy").alias("model_accuracy"),
        of(baseline, "sentence_accuracy").alias("baseline_accuracy"),
    )
    return out.withColumn(
        "delta", F.bround(F.col("model_accuracy") - F.col("baseline_accuracy"), 4)
    ).withColumn("beats_baseline", F.col("model_accuracy") >= F.col("baseline_accuracy"))


def model_deltas(model: DataFrame, baseline: DataFrame, *keys: str) -> DataFrame:
    """Metric differences of two long score tables ``(keys, metric, value)``."""
    on = [*keys, "metric"]
    return (
        model.withColumnRenamed("value", "model_value")
        .join(baseline.withColumnRenamed("value", "baseline_value"), on)
        .withColumn("delta", F.bround(F.col("model_value") - F.col("baseline_value"), 4))
    )


def error_totals(scored: DataFrame, *keys: str) -> DataFrame:
    """Errors summed over classes: a row with two classes counts twice."""
    return class_scores(scored, *keys).groupBy(*keys).agg(F.sum("errors").alias("errors"))


def _is_unrecoverable() -> Column:
    numeric = F.arrays_overlap("classes", F.array(*[F.lit(c) for c in NUMERIC_CLASSES]))
    return ~F.col("correct") & F.coalesce(numeric, F.lit(False))


def unrecoverable_examples(scored: DataFrame, limit: int, slices: list[str], key: str = "pair_id") -> DataFrame:
    """First unrecoverable errors of each slice by key."""
    return first_rows(scored.filter(_is_unrecoverable()), limit, slices, [key])


def preferred(classes: DataFrame, slice_col: str, order: list[str], *keys: str) -> DataFrame:
    """Rows of the first slice of ``order`` that a key has; keys with none of them have no rows."""
    rank = F.when(F.lit(False), 0)
    for k, name in enumerate(order):
        rank = rank.when(F.col(slice_col) == name, k)
    ranked = classes.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*keys, "_rank"], "left_semi").drop("_rank")


def unrecoverable(scored: DataFrame, *keys: str) -> DataFrame:
    """Errors on rows with a numeric class: count and rate over all rows."""
    return (
        scored.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(_is_unrecoverable()).alias("n_unrecoverable"))
        .withColumn("rate", ratio(F.col("n_unrecoverable"), F.col("n")))
    )


def first_rows(df: DataFrame, limit: int, slices: list[str], order: list[str]) -> DataFrame:
    """First rows of each slice; the rank limit runs before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*slices).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def error_examples(scored: DataFrame, limit: int, slices: list[str], key: str = "pair_id") -> DataFrame:
    """First mistakes of each slice by key."""
    return first_rows(scored.filter(~F.col("correct")), limit, slices, [key])


def worst_classes(classes: DataFrame) -> DataFrame:
    """Per-class report, lowest accuracy first."""
    return classes.orderBy("accuracy", "cls")
