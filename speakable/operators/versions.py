"""Model versions against each other: frozen sets, confidence histograms, the gate before a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .score import exploded_classes, ratio

BINS = 20
SHIFT_LIMIT = 0.1
SENTENCE, MACRO, CLASS = "sentence_accuracy", "macro_class_accuracy", "class:"


def golden_regression(scored: DataFrame, version: str = "version", key: str = "pair_id") -> DataFrame:
    """Consecutive versions per class on a frozen set.

    ``scored`` has a row per version and pair: classes and ``correct``. Rows
    won and lost are pairs that both versions answered. A class that one side
    lacks is a row as well. Status: ``first`` (no version before), ``new`` and
    ``missing`` (the class is absent before or now), ``regressed`` (accuracy
    fell), else ``held``. The order is that of the version's values.
    """
    names = scored.select(version).distinct()
    # One row per version: the window is over names, not over scores.
    ranked = names.withColumn("_rank", F.row_number().over(Window.orderBy(version)))
    rows = exploded_classes(scored).select(version, key, "cls", F.col("correct").cast("int").alias("correct"))
    rows = rows.groupBy(version, key, "cls").agg(F.min("correct").alias("correct"))
    rows = rows.join(F.broadcast(ranked), version)
    # All answers to a pair stand together, one per version.
    before = Window.partitionBy(key, "cls").orderBy("_rank")
    last_rank, last = F.lag("_rank").over(before), F.lag("correct").over(before)
    rows = rows.withColumn("_was", F.when(last_rank == F.col("_rank") - 1, last))
    per = rows.groupBy("_rank", "cls").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("correct").alias("n_correct"),
        F.count_if((F.col("_was") == 1) & (F.col("correct") == 0)).alias("n_lost"),
        F.count_if((F.col("_was") == 0) & (F.col("correct") == 1)).alias("n_won"),
    )
    now = per.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n")))
    was = now.select((F.col("_rank") + 1).alias("_rank"), "cls", F.col("n").alias("n_before"), F.col("accuracy").alias("accuracy_before"))
    both = now.join(was, ["_rank", "cls"], "full").join(F.broadcast(ranked), "_rank")
    delta = F.bround(F.col("accuracy") - F.col("accuracy_before"), 4)
    status = (
        F.when(F.col("_rank") == 1, "first")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n_before").isNull(), "new")
        .when(delta < 0, "regressed")
        .otherwise("held")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_before", "n_lost", "n_won")]
    return both.select(version, "cls", *zero, "accuracy", "accuracy_before", delta.alias("delta"), status.alias("status"))


def bin_of(value: Column, bins: int = BINS) -> Column:
    """Bin of a value from 0 to 1; what lies outside goes to the end bins, null and NaN to none."""
    at = F.floor(value * bins).cast("int")
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)))


def histogram(rows: DataFrame, value: str, *keys: str, bins: int = BINS) -> DataFrame:
    """Rows per bin of fixed edges: keys, bin, n. Histograms are merged by adding ``n``, see ``merged``."""
    return rows.withColumn("bin", bin_of(F.col(value), bins)).filter("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def histogram_shift(base: DataFrame, recent: DataFrame, *keys: str, bins: int = BINS, limit: float = SHIFT_LIMIT) -> DataFrame:
    """Distance of two histograms: the largest gap of their cumulated shares, with its sign.

    A positive gap says that more of ``recent`` lies below the edge ``edge``: a
    shift to the left, reported as ``left_shift`` from ``limit`` on. Of equal gaps
    the lowest edge counts. A key that one side lacks has no gap.
    """
    both = merged(base, *keys).withColumn("side", F.lit(0)).unionByName(merged(recent, *keys).withColumn("side", F.lit(1)))
    at = F.sequence(F.lit(0), F.lit(bins - 1))
    # A key has at most two rows per bin.
    wide = both.groupBy(*keys).agg(*(F.map_from_entries(F.collect_list(F.when(F.col("side") == k, F.struct("bin", "n")))).alias(f"m{k}") for k in (0, 1)))

    def counted(m: Column) -> Column:
        return F.transform(at, lambda b: F.coalesce(F.element_at(m, b), F.lit(0)))

    wide = wide.withColumn("c0", counted(F.col("m0"))).withColumn("c1", counted(F.col("m1")))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    wide = wide.withColumn("n_base", total(F.col("c0"))).withColumn("n_recent", total(F.col("c1")))
    below = lambda c, b: total(F.slice(c, F.lit(1), b + 1))
    gap = lambda b: F.bround(below(F.col("c1"), b) / F.col("n_recent") - below(F.col("c0"), b) / F.col("n_base"), 4)
    gaps = F.transform(at, lambda b: F.struct(F.abs(gap(b)).alias("size"), (-b).alias("low"), gap(b).alias("gap")))
    known = (F.col("n_base") > 0) & (F.col("n_recent") > 0)
    wide = wide.withColumn("best", F.when(known, F.array_max(gaps)))
    return wide.select(
        *keys, "n_base", "n_recent", F.col("best.gap").alias("gap"),
        F.when(known, (1 - F.col("best.low")) / F.lit(bins)).alias("edge"),
        F.coalesce(F.col("best.gap") >= limit, F.lit(False)).alias("left_shift"),
    )


def metric_rows(scores: DataFrame, classes: DataFrame, *keys: str) -> DataFrame:
    """Score tables as one long table ``(keys, metric, value)``."""
    wide = [scores.select(*keys, F.lit(m).alias("metric"), F.col(m).alias("value")) for m in (SENTENCE, MACRO)]
    per = classes.select(*keys, F.concat(F.lit(CLASS), "cls").alias("metric"), F.col("accuracy").alias("value"))
    return wide[0].unionByName(wide[1]).unionByName(per)


def gate_checks(candidate: DataFrame, incumbent: DataFrame, *keys: str) -> DataFrame:
    """Every metric of either side with the reason why it stops a release, null where it does not.

    A sentence accuracy must be beaten, a tie is not enough; the macro accuracy
    must not fall; a class that the incumbent has must be there. A
    metric that is absent or undefined on a side that needs it is a reason too.
    """
    on = [*keys, "metric"]
    new, old = candidate.select(*on, F.col("value").alias("candidate")), incumbent.select(*on, F.col("value").alias("incumbent"))
    # A side that has the metric with a null value is told from one that lacks it.
    both = new.withColumn("_new", F.lit(True)).join(old.withColumn("_old", F.lit(True)), on, "full")
    c, i = F.col("candidate"), F.col("incumbent")
    undefined = lambda x: x.isNull() | F.isnan(x)
    per_class = F.col("metric").startswith(CLASS)
    reason = (
        F.when(F.col("_new").isNull(), "missing")
        .when(per_class & F.col("_old").isNull(), None)
        .when(undefined(c), "undefined")
        .when(per_class, None)
        .when(F.col("_old").isNull() | undefined(i), "no incumbent value")
        .when((F.col("metric") == SENTENCE) & (c <= i), F.when(c == i, "tie").otherwise("below incumbent"))
        .when((F.col("metric") == MACRO) & (c < i), "macro fell")
    )
    return both.select(*on, "candidate", "incumbent", reason.alias("reason"))


def promotion_gate(checks: DataFrame, slices: str, *keys: str) -> DataFrame:
    """One verdict per key over all slices: ``promoted``, number of checks, and the reasons against it in order.

    Without any check of a sentence accuracy nothing is promoted.
    """
    line = F.concat_ws(" ", F.concat(F.col(slices), F.lit(":")), "metric", "reason")
    bad = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), line)))
    out = checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("reason").isNotNull()).alias("n_failed"),
        F.count_if(F.col("metric") == SENTENCE).alias("_n"), F.array_join(bad, "; ").alias("reasons"),
    )
    return out.withColumn("promoted", (F.col("n_failed") == 0) & (F.col("_n") > 0)).drop("_n")
