"""The batch flows end to end: raw claims to split table, split table to saved model and report, or to the best of three models."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.fixed_values import MIN_SUPPORT, SAMPLE_SIZE, TAXONOMY, TEST_SHARE, VOCABULARY_FULL, VOCABULARY_SAMPLE
from claimsift.operators.cleaning import harmonise_tag, min_support_filter, select_useful, unique_keys, usable_text
from claimsift.operators.metrics import pick_best
from claimsift.operators.models import (
    LinearTextModel, batch_latency, compare_models, evaluation_report, predict, prepare_training, train_all,
)
from claimsift.operators.sampling import nested_sample, stratified_split
from claimsift.session import materialise
from claimsift.sources.model_store import load_or_train_model, refuse_training_metrics, save_model
from claimsift.sources.reports import write_comparison, write_metrics_json
from claimsift.sources.splits import read_split, write_split


def make_splits(
    raw: DataFrame, path: str, taxonomy: Mapping[str, str] = TAXONOMY, minimum: int = MIN_SUPPORT,
    test_share: float = TEST_SHARE, sample_size: int = SAMPLE_SIZE,
) -> None:
    """Clean, deduplicate, harmonise, drop rare classes, split, draw the sample, write.

    All decisions are taken on keys; texts are read once to be digested and once to be written.
    """
    usable = usable_text(select_useful(raw))
    keys = harmonise_tag(unique_keys(usable).drop("digest"), taxonomy).select("claim_id", "tag_clean")
    kept = min_support_filter(keys, minimum)
    sides = materialise(stratified_split(kept, test_share=test_share), "sides")
    drawn = materialise(nested_sample(sides, sample_size), "sides")
    write_split(usable.select("claim_id", "claim").join(drawn, "claim_id"), path)


def export_model(
    spark: SparkSession, split_path: str, out: str, stop_words: Sequence[str], saved: str | None = None,
    full_size: int = VOCABULARY_FULL, sample_size: int = VOCABULARY_SAMPLE, has_train: bool = True,
) -> tuple[LinearTextModel, str]:
    """Use the saved model or train one, evaluate it on the sample, write model and report to ``out``.

    A model that had to be trained on the sample is written without a report.
    """
    sample = read_split(spark, split_path, "sample")
    train = read_split(spark, split_path, "train") if has_train else None
    model, trained_on = load_or_train_model(
        spark, saved or f"{out}/model", train, sample, stop_words, full_size, sample_size
    )
    if saved is not None or trained_on != "saved":
        save_model(model, f"{out}/model")
    if trained_on == "sample":
        return model, trained_on
    refuse_training_metrics(trained_on)
    timing = batch_latency(sample, lambda df: predict(df, model, "claim_id"))
    scored = predict(sample, model, "claim_id", "tag_clean").select(
        F.col("tag_clean").alias("y_true"), F.col("predicted").alias("y_pred")
    )
    stamp = time.strftime("%Y-%m-%d %H:%M:%SZ", time.gmtime())
    write_metrics_json(evaluation_report(scored, model, timing["ms_per_claim"], stamp), f"{out}/metrics")
    return model, trained_on


def best_model_export(
    spark: SparkSession, split_path: str, out: str, stop_words: Sequence[str], size: int = VOCABULARY_FULL,
) -> tuple[DataFrame, LinearTextModel]:
    """Train the three classifiers, compare them, save the best one and write the comparison to ``out``."""
    split = read_split(spark, split_path, "train").unionByName(read_split(spark, split_path, "test"))
    table = prepare_training(split, size, stop_words)
    models = train_all(table)
    comparison = materialise(compare_models(table, models), "comparison")
    name = pick_best(comparison).first()["model"]
    best = next(m for m in models if m.name == name)
    save_model(best, f"{out}/model")
    write_comparison(comparison, f"{out}/comparison")
    return comparison, best
