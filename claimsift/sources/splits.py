"""Split tables: one Parquet table partitioned by side, so reading a side reads only its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.schemas import PREDICTIONS, SPLIT
from claimsift.sources.csv_files import write_csv


def write_split(split: DataFrame, path: str) -> None:
    split.select(*SPLIT.names).write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, side: str) -> DataFrame:
    """``train``, ``test`` or ``sample`` (a subset of the test side)."""
    table = spark.read.schema(SPLIT).parquet(path)
    if side == "sample":
        return table.where((F.col("split") == "test") & F.col("in_sample"))
    return table.where(F.col("split") == side)


def write_split_csv(split: DataFrame, path: str, side: str) -> None:
    """The two published columns of one side, with their published names."""
    rows = split.where((F.col("split") == "test") & F.col("in_sample")) if side == "sample" else split.where(
        F.col("split") == side
    )
    write_csv(rows.select(F.col("claim").alias("Consumer Claim"), F.col("tag_clean").alias("Tag_Clean")), path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select(*PREDICTIONS.names).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).parquet(path)
