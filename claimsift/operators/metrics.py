"""Scores of a classifier.  Everything derives from the (true, predicted) counts: one pass over the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimsift.fixed_values import PROGRESS_EVERY
from claimsift.session import materialise

BUCKETS = 1024  # ranges that a quantile's values are counted in at a time


def confusion_counts(predictions: DataFrame, *by: str) -> DataFrame:
    """Rows per (true, predicted), optionally per engine or model."""
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _per_label(counts: DataFrame, *by: str) -> DataFrame:
    """(label, support, predicted, correct) over the union of true and predicted labels."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    return (
        counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_union(counts: DataFrame) -> DataFrame:
    """True and predicted labels as one set."""
    return counts.select(F.col("y_true").alias("label")).union(counts.select(F.col("y_pred"))).distinct()


def per_class_report(counts: DataFrame, *by: str, digits: int | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label; 0 where undefined."""
    scored = (
        _per_label(counts, *by)
        .withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")))
    )
    shown = [F.round(c, digits).alias(c) if digits is not None else F.col(c) for c in ("precision", "recall", "f1")]
    return scored.select(*by, "label", *shown, "support")


def accuracy(counts: DataFrame, *by: str) -> DataFrame:
    hits = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(
        hits.alias("correct"), F.sum("n").alias("total"), _ratio(hits, F.sum("n")).alias("accuracy")
    )


def macro_average(report: DataFrame, *by: str) -> DataFrame:
    """Plain mean over labels; a label that is only ever predicted counts too."""
    return report.groupBy(*by).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def weighted_average(report: DataFrame, *by: str) -> DataFrame:
    """Mean weighted by support."""
    return report.groupBy(*by).agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
          for c in ("precision", "recall", "f1")]
    )


def confusion_grid(counts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Zero-filled square in long form; ``labels`` defaults to the union of both sides.

    The counts are used twice, so they are written: the rows behind them are read once.
    """
    counts = materialise(counts.select("y_true", "y_pred", "n"), "confusion")
    names = label_union(counts) if labels is None else labels
    every = F.sort_array(F.collect_set("label"))  # one entry per class
    cells = names.agg(every.alias("all")).select("all", F.explode("all").alias("y_true")).select(
        "y_true", F.explode("all").alias("y_pred")
    )
    return cells.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def wide_grid(grid: DataFrame, labels: list[str]) -> DataFrame:
    """The grid with one column per predicted label, in the given order."""
    return grid.groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))


def order_statistic(df: DataFrame, value: str, rank: int, low: float, high: float) -> float:
    """The value of a rank (from 0) among the non-null values, all within ``low`` and ``high``.

    Values are counted in BUCKETS ranges between the ends; the range that holds the rank is cut again
    until all its values are equal.  Each round is one pass that returns BUCKETS rows at most.
    """
    v = F.col(value).cast("double")
    while low < high:
        share = (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)  # halves, so that the width stays finite
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        cells = df.where((v >= low) & (v <= high)).groupBy(bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        for cell in sorted(cells):
            if rank < cell["n"]:
                low, high = cell["low"], cell["high"]
                break
            rank -= cell["n"]
        else:
            raise RuntimeError("the table changed between two passes")
    return low


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One-row table ``quantile``: linear interpolation between order statistics, exact at any size; null without values."""
    rows = df.where(F.col(value).isNotNull())
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(value).cast("double"), F.max(value).cast("double")).first()
    found = None
    if n:
        rank = q * (n - 1)
        a = order_statistic(rows, value, math.floor(rank), low, high)
        b = order_statistic(rows, value, math.ceil(rank), low, high) if rank > math.floor(rank) else a
        found = a + (b - a) * (rank - math.floor(rank))
    return df.sparkSession.range(1).select(F.lit(found).cast("double").alias("quantile"))


def latency_stats(predictions: DataFrame, latency: str = "latency_sec") -> DataFrame:
    """Mean and median seconds per claim."""
    median = exact_quantile(predictions, latency, 0.5).scalar()
    return predictions.agg(F.avg(latency).alias("mean_sec")).select("mean_sec", median.alias("median_sec"))


def progress_latency(
    predictions: DataFrame, position: str = "position", latency: str = "latency_sec", every: int = PROGRESS_EVERY
) -> DataFrame:
    """At every ``every``-th row and at the last: rows done, % done, mean of the last ``every`` latencies.

    Full blocks are plain groups; an incomplete last block covers the ``every`` highest positions.
    """
    n = predictions.agg(F.max(position)).scalar()
    rows = predictions.select(F.col(position).alias("p"), F.col(latency).alias("l")).withColumn("n", n)
    block_end = F.ceil(F.col("p") / F.lit(every)) * F.lit(every)
    full = F.when(block_end <= F.col("n"), block_end)
    tail = F.when((F.col("n") % every != 0) & (F.col("p") > F.col("n") - every), F.col("n"))
    reports = rows.select("n", "l", F.explode(F.array(full, tail)).alias("done")).where("done IS NOT NULL")
    return reports.groupBy("done", "n").agg(F.avg("l").alias("mean_latency")).select(
        F.col("done").cast("bigint").alias("done"),
        F.round(F.col("done") * F.lit(100.0) / F.col("n"), 6).alias("pct_done"),
        F.round("mean_latency", 6).alias("mean_latency"),
    )


def engine_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two engines on the same claims: accuracy, weighted F1, latency, difference in points, speed ratio."""
    left = a.select("claim_id", "y_true", F.struct(F.lit("a").alias("engine"), "y_pred", "latency_sec").alias("a"))
    right = b.select("claim_id", F.struct(F.lit("b").alias("engine"), "y_pred", "latency_sec").alias("b"))
    both = left.join(right, "claim_id").select("y_true", F.explode(F.array("a", "b")).alias("p")).select("y_true", "p.*")
    cells = materialise(
        both.groupBy("engine", "y_true", "y_pred").agg(
            F.count(F.lit(1)).alias("n"), F.sum("latency_sec").alias("seconds")
        ),
        "confusion",
    )
    report = per_class_report(cells, "engine")
    rows = (
        accuracy(cells, "engine").join(weighted_average(report, "engine"), "engine")
        .join(cells.groupBy("engine").agg((F.sum("seconds") / F.sum("n")).alias("mean_latency")), "engine")
    )

    def of(engine: str, column: str) -> Column:
        return F.max(F.when(F.col("engine") == engine, F.col(column)))

    return rows.agg(
        F.max("total").alias("n"),
        F.round(of("a", "accuracy"), 6).alias("accuracy_a"), F.round(of("b", "accuracy"), 6).alias("accuracy_b"),
        F.round(of("a", "weighted_f1"), 6).alias("f1_a"), F.round(of("b", "weighted_f1"), 6).alias("f1_b"),
        F.round(of("a", "mean_latency"), 6).alias("latency_a"), F.round(of("b", "mean_latency"), 6).alias("latency_b"),
        F.round((of("a", "accuracy") - of("b", "accuracy")) * 100, 6).alias("accuracy_points"),
        F.round(F.try_divide(of("b", "mean_latency"), of("a", "mean_latency")), 6).alias("speed_ratio"),
    )


def f1_by_class_comparison(predictions: DataFrame, engine_a: str, engine_b: str) -> DataFrame:
    """F1 per class of two engines side by side; ``predictions`` has an ``engine`` column."""
    report = per_class_report(confusion_counts(predictions, "engine"), "engine")

    def of(engine: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("engine") == engine, F.col("f1"))), F.lit(0.0))

    return report.groupBy("label").agg(
        F.round(of(engine_a), 6).alias("f1_a"), F.round(of(engine_b), 6).alias("f1_b"),
        F.round(of(engine_a) - of(engine_b), 6).alias("f1_difference"),
    )


def pick_best(comparison: DataFrame, score: str = "f1_sample", order: str = "model_order") -> DataFrame:
    """Highest score; the first model wins ties."""
    return comparison.orderBy(F.desc(score), F.asc(order)).limit(1)
