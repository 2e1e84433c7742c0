"""Report and seed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.functions.text import strip_text
from claimsift.sources.csv_files import write_csv

# Header of the published comparison file.
COMPARISON_HEADER = [
    "Modèle", "Accuracy (1k LLM)", "F1-Weighted (1k)", "Accuracy (73k Test)", "F1-Weighted (73k)",
    "Temps Entraînement (s)", "Latence / ticket (ms)",
]


def _percent(name: str) -> Column:
    return F.format_string("%.2f%%", F.col(name) * 100)


def write_comparison(comparison: DataFrame, path: str) -> None:
    """A row per model; numbers become text only here."""
    shown = comparison.orderBy("model_order").select(
        F.col("model"), _percent("acc_sample"), F.round("f1_sample", 4), _percent("acc_full"), F.round("f1_full", 4),
        F.round("train_s", 2), F.round("ms_per_claim", 4),
    ).toDF(*COMPARISON_HEADER)
    write_csv(shown.coalesce(1), path)


def write_metrics_json(report: DataFrame, path: str) -> None:
    """The one nested report document."""
    report.coalesce(1).write.mode("overwrite").json(path)


def seed_records(rows: DataFrame) -> DataFrame:
    """(claim, tag_clean, position) to the records of the seed file, in position order."""
    return rows.orderBy("position").select(
        strip_text("claim").alias("content"), F.lit(None).cast("string").alias("tag"),
        F.col("tag_clean").alias("_expected_tag"),
    )


def write_seed_json(rows: DataFrame, path: str) -> None:
    """Null tags are written out, not left away."""
    seed_records(rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
