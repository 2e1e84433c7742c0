"""Saved models: one table with term, idf and coefficients, and one document with the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import VOCABULARY_FULL, VOCABULARY_SAMPLE
from claimsift.operators.features import encode_labels, fit_label_encoder, weight_arrays, write_features
from claimsift.operators.models import LinearTextModel, Vectoriser, fit_vectoriser, train_logistic

META = (
    "name string, labels array<string>, intercepts array<double>, link string, stop_words array<string>, "
    "low int, high int, facts map<string, string>"
)


def save_model(model: LinearTextModel, path: str) -> None:
    """Vectoriser, classifier and labels together."""
    v = model.vectoriser
    spark = model.coefficients.sparkSession
    terms = spark.createDataFrame(list(enumerate(v.vocabulary)), "idx int, term string")
    table = terms.join(v.idf.select("idx", "idf"), "idx", "left").join(model.coefficients, "idx", "left")
    table.write.mode("overwrite").parquet(f"{path}/terms")
    row = (
        model.name, model.labels, model.intercepts, model.link, v.stop_words, v.low, v.high,
        {k: str(value) for k, value in model.facts.items()},
    )
    spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> LinearTextModel:
    meta = spark.read.schema(META).json(f"{path}/meta").first()
    table = spark.read.schema("idx int, term string, idf double, coef array<double>").parquet(f"{path}/terms")
    vocabulary = [r["term"] for r in table.select("idx", "term").orderBy("idx").collect()]  # bounded by its size
    vectoriser = Vectoriser(vocabulary, table.select("idx", "idf"), list(meta["stop_words"]), meta["low"], meta["high"])
    return LinearTextModel(
        meta["name"], vectoriser, list(meta["labels"]), list(meta["intercepts"]), table.select("idx", "coef"),
        meta["link"], dict(meta["facts"] or {}),
    )


def train_exported_model(train: DataFrame, size: int, stop_words: Sequence[str]) -> LinearTextModel:
    """Logistic regression on (claim_id, claim, tag_clean)."""
    rows = train.select("claim_id", "claim", "tag_clean")
    vectoriser, counted = fit_vectoriser(rows, size, stop_words)
    encoder = fit_label_encoder(rows)
    vectors, _ = write_features(weight_arrays(counted, vectoriser.idf), len(vectoriser.vocabulary))
    encoded = encode_labels(vectors, encoder).select("features", "label").persist()
    try:
        return train_logistic(encoded, vectoriser, encoder.labels)
    finally:
        encoded.unpersist()


def load_or_train_model(
    spark: SparkSession, path: str, train: DataFrame | None, sample: DataFrame | None, stop_words: Sequence[str],
    full_size: int = VOCABULARY_FULL, sample_size: int = VOCABULARY_SAMPLE,
) -> tuple[LinearTextModel, str]:
    """The saved model, else one trained on the train side, else one trained on the sample.

    The second value says which: ``saved``, ``train`` or ``sample``.
    """
    try:
        return load_model(spark, path), "saved"
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if train is not None:
        return train_exported_model(train, full_size, stop_words), "train"
    if sample is None:
        raise ValueError("no saved model, no train side and no sample")
    return train_exported_model(sample, sample_size, stop_words), "sample"


def refuse_training_metrics(trained_on: str) -> None:
    """A model trained on the evaluation sample has no test metrics."""
    if trained_on == "sample":
        raise ValueError("this model was trained on the sample it would be evaluated on")
