"""Linear text classifiers: training, one scoring operator for all, comparison, report.

Multinomial logistic regression, multinomial naive Bayes and one-vs-rest logistic regression all score
a claim by ``intercept[k] + sum(weight x coefficient[k])``.  A fitted model is therefore one table with
a row per vocabulary term and an array of K coefficients.  Scoring sends that table, bounded by the
vocabulary, to the tasks as one matrix: no join, no shuffle, and a claim that occurs twice is scored twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsift.fixed_values import LINEAR_ALPHA, LOGISTIC_C, MASKS_TRAINING, MAX_ITERATIONS, NB_ALPHA
from claimsift.operators import newton
from claimsift.operators.blocks import Rows, list_column
from claimsift.operators.features import (
    TermBook, code_tokens, count_arrays, count_coded, count_tokens, encode_labels, fit_label_encoder, fit_vocabulary, fit_vocabulary_of_coded,
    idf_smooth, long_form, term_counter, weight_arrays, with_terms, write_features,
)
from claimsift.functions.text import with_tokens
from claimsift.operators.metrics import accuracy, confusion_counts, per_class_report, weighted_average
from claimsift.operators.newton import Trust, minimise
from claimsift.operators.stochastic import Descent, descend
from claimsift.session import materialise

BROADCAST_BYTES = 256 * 1024 * 1024
MOST_CLASSES = 10_000
TOLERANCE = 1e-6  # relative gain of the mean loss below which the solver of the hinge stops: the default of the ML library


@dataclass
class Vectoriser:
    """Vocabulary and idf of the train side."""

    vocabulary: list[str]
    idf: DataFrame
    stop_words: list[str]
    low: int = 1
    high: int = 2

    @cached_property
    def counter(self) -> CountVectorizerModel:
        return term_counter(self.vocabulary)

    @cached_property
    def book(self) -> TermBook:
        return TermBook(self.vocabulary)

    def counts(self, df: DataFrame, text: str = "claim") -> DataFrame:
        """Replace the text by ``indices`` and ``counts``."""
        if (self.low, self.high) == (1, 2):
            return count_tokens(with_tokens(df, text, "_tokens", self.stop_words).drop(text), self.book, "_tokens")
        return count_arrays(with_terms(df, text, self.stop_words, self.low, self.high).drop(text), self.counter)

    def transform(self, df: DataFrame, text: str = "claim") -> DataFrame:
        """Replace the text by ``indices`` and ``weights``."""
        return weight_arrays(self.counts(df, text), self.idf)


@dataclass
class LinearTextModel:
    """A vectoriser with the coefficients of one classifier."""

    name: str
    vectoriser: Vectoriser
    labels: list[str]
    intercepts: list[float]
    coefficients: DataFrame  # idx, coef array<double>
    link: str  # softmax | one_vs_rest
    facts: dict = field(default_factory=dict)

    @cached_property
    def matrix(self) -> np.ndarray:
        """Terms x classes.  Every term of the vocabulary must have its row; at most BROADCAST_BYTES."""
        k, terms = len(self.labels), len(self.vectoriser.vocabulary)
        if terms * k * 8 > BROADCAST_BYTES:
            raise ValueError(f"{terms} terms and {k} classes are more than a row can be scored with ({BROADCAST_BYTES} bytes)")
        rows = self.coefficients.select("idx", "coef").limit(terms + 1).toArrow().combine_chunks()
        place = rows.column("idx").to_numpy()
        if len(place) != terms or not np.array_equal(np.sort(place), np.arange(terms)):
            raise ValueError("coefficients and vocabulary differ")
        matrix = np.zeros((terms, k))
        if terms:
            matrix[place] = rows.column("coef").combine_chunks().flatten().to_numpy().reshape(terms, k)
        return matrix


def _counted(df: DataFrame, is_train: Column, size: int, words: Sequence[str], text: str = "claim") -> tuple[list[str], DataFrame]:
    """The vocabulary of the train side, and all rows counted against it; texts are tokenised once, and stored as places of words."""
    coded = materialise(code_tokens(with_tokens(df, text, "_tokens").drop(text), is_train, "_tokens", words), "tokens")
    vocabulary = fit_vocabulary_of_coded(coded, size)
    return vocabulary, materialise(count_coded(coded, TermBook(vocabulary)), "counts")


def fit_vectoriser(
    train: DataFrame, size: int, stop_words: Sequence[str], masks: Sequence[str] = tuple(MASKS_TRAINING),
    text: str = "claim", low: int = 1, high: int = 2,
) -> tuple[Vectoriser, DataFrame]:
    """Vocabulary, then counts against it (written once), then idf.  Also returns the counted train side."""
    words = [*stop_words, *masks]
    if (low, high) == (1, 2):
        vocabulary, counted = _counted(train, F.lit(True), size, words, text)
    else:
        terms = with_terms(train, text, words, low, high).drop(text)
        vocabulary = fit_vocabulary(terms, size)
        counted = materialise(count_arrays(terms, term_counter(vocabulary)), "counts")
    return Vectoriser(vocabulary, materialise(idf_smooth(counted), "idf"), words, low, high), counted


def class_names(df: DataFrame, label: str = "tag_clean") -> list[str]:
    """Distinct labels in alphabetical order: one entry per class, MOST_CLASSES at most."""
    names = [r[0] for r in df.select(label).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return sorted(names)


def train_naive_bayes(
    features: DataFrame, vectoriser: Vectoriser, labels: Sequence[str], alpha: float = NB_ALPHA, label: str = "tag_clean"
) -> LinearTextModel:
    """Multinomial naive Bayes on TF-IDF weights with the empirical class prior.

    One aggregation by term with one sum per class; a hot term is combined on the map side.
    """
    v = len(vectoriser.vocabulary)
    in_class = [F.col(label) == name for name in labels]
    prior = features.agg(*[F.count(F.when(c, 1)).alias(f"c{k}") for k, c in enumerate(in_class)]).first()
    sums = materialise(
        long_form(features, label).groupBy("idx")
        .agg(*[F.sum(F.when(c, F.col("weight")).otherwise(0.0)).alias(f"s{k}") for k, c in enumerate(in_class)]),
        "class-sums",
    )
    totals = sums.agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(len(labels))]).first()
    theta = F.array(*[
        F.log((F.col(f"s{k}") + F.lit(alpha)) / F.lit((totals[k] or 0.0) + alpha * v)) for k in range(len(labels))
    ])
    n = sum(prior)
    return LinearTextModel(
        "Multinomial Naive Bayes", vectoriser, list(labels), [float(np.log(c / n)) for c in prior],
        materialise(sums.select("idx", theta.alias("coef")), "coefficients"), "softmax",
    )


def _coefficient_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """One row per vocabulary term; the matrix comes from the solver, which holds it on the driver anyway."""
    rows = pa.table({"idx": pa.array(np.arange(matrix.shape[1]), pa.int32()), "coef": list_column(np.ascontiguousarray(matrix.T))})
    return materialise(spark.createDataFrame(rows), "coefficients")


def train_logistic(
    vectors: DataFrame, vectoriser: Vectoriser, labels: Sequence[str], c: float = LOGISTIC_C, trust: Trust = Trust(steps=MAX_ITERATIONS),
) -> LinearTextModel:
    """Multinomial logistic regression, L2, by a trust-region Newton method.

    C weighs the summed loss, the solver the mean loss: the penalty is 1 / (C n).
    """
    found = minimise(vectors, len(vectoriser.vocabulary), len(labels), lambda n: 1.0 / (c * n), newton.Softmax, trust)
    return LinearTextModel(
        "Logistic Regression", vectoriser, list(labels), found.matrix[-1].tolist(),
        _coefficient_table(vectors.sparkSession, found.matrix[:-1].T), "softmax",
        {"iterations": len(found.gradients) - 1, "passes": found.passes, "gradient_left": found.gradients[-1] / (found.gradients[0] or 1.0)},
    )


def train_linear_sgd(
    vectors: DataFrame, vectoriser: Vectoriser, labels: Sequence[str], alpha: float = LINEAR_ALPHA, **how: float,
) -> LinearTextModel:
    """One binary logistic model per class by stochastic gradient descent; ``how`` changes parts of ``Descent``."""
    state, losses = descend(vectors, len(vectoriser.vocabulary), len(labels), Descent(alpha, **how))
    return LinearTextModel(
        "Linear SVM (SGD)", vectoriser, list(labels), state.bias.tolist(),
        _coefficient_table(vectors.sparkSession, state.weights.T), "one_vs_rest", {"losses": losses},
    )


def train_linear_ovr(
    vectors: DataFrame, vectoriser: Vectoriser, labels: Sequence[str], alpha: float = LINEAR_ALPHA,
    max_iter: int = MAX_ITERATIONS, hinge: bool = False, parallelism: int = 4,
) -> LinearTextModel:
    """One binary model per class at its optimum: logistic loss by Newton steps for all classes at once, or the hinge of a linear SVM."""
    if not hinge:
        found = minimise(vectors, len(vectoriser.vocabulary), len(labels), lambda n: alpha, newton.OneVsRest, Trust(steps=max_iter))
        return LinearTextModel(
            "Linear SVM (SGD)", vectoriser, list(labels), found.matrix[-1].tolist(),
            _coefficient_table(vectors.sparkSession, found.matrix[:-1].T), "one_vs_rest",
            {"iterations": len(found.gradients) - 1, "passes": found.passes, "gradient_left": found.gradients[-1] / (found.gradients[0] or 1.0)})
    base = LinearSVC(regParam=alpha, standardization=False, maxIter=max_iter, tol=TOLERANCE)
    fitted = OneVsRest(classifier=base, parallelism=parallelism).fit(vectors)
    matrix = np.vstack([m.coefficients.toArray() for m in fitted.models])
    return LinearTextModel(
        "Linear SVM (SGD)", vectoriser, list(labels), [float(m.intercept) for m in fitted.models],
        _coefficient_table(vectors.sparkSession, matrix), "one_vs_rest",
    )


def score(features: DataFrame, model: LinearTextModel, *keep: str) -> DataFrame:
    """Add ``scores``, ``probabilities``, ``class_index`` and ``predicted`` to the ``keep`` columns.

    Every row is scored by itself: blocks of sparse rows times the matrix of coefficients, which is sent
    to the tasks once.  A claim without any known term gets the intercepts.  Equal scores (to nine
    decimals) go to the first class.
    """
    softmax, names = model.link == "softmax", np.array(model.labels, object)
    shared = features.sparkSession.sparkContext.broadcast((model.matrix, np.array(model.intercepts)))
    rows = features.select(
        *keep, F.coalesce("indices", F.array()).cast("array<int>").alias("_indices"),
        F.coalesce("weights", F.array()).cast("array<double>").alias("_weights"))
    kept = len(rows.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, intercepts = shared.value
        for batch in batches:
            scores = Rows(batch).times(matrix) + intercepts
            chance = np.exp(scores - scores.max(axis=1, keepdims=True)) if softmax else 1.0 / (1.0 + np.exp(-scores))
            best = np.round(scores, 9).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], list_column(scores), list_column(chance / chance.sum(axis=1, keepdims=True)),
                 pa.array(best, pa.int32()), pa.array(names[best], pa.string())],
                names=[*batch.schema.names[:kept], "scores", "probabilities", "class_index", "predicted"])

    added = T.StructType.fromDDL("scores array<double>, probabilities array<double>, class_index int, predicted string")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:kept], *added.fields]))


def predict(df: DataFrame, model: LinearTextModel, *keep: str, text: str = "claim") -> DataFrame:
    """Texts to scores and classes; ``keep`` starts with the row key."""
    return score(model.vectoriser.transform(df.select(*keep, text), text), model, *keep)


def gradient_norms(train: DataFrame, model: LinearTextModel, penalty: float, label: str = "tag_clean") -> DataFrame:
    """(label, norm, start_norm): the gradient of the fitted loss per class, at the model and at zero coefficients.

    ``train`` has features in arrays.  The mean log loss (softmax, or one sigmoid per class) and half
    ``penalty`` times the squared coefficients are what the solvers minimise; at the optimum the norm is 0.
    """
    k, n = len(model.labels), train.count()
    scored = score(train, model, "claim_id", label, "indices", "weights")
    if model.link == "softmax":
        chance, start = F.col("probabilities"), 1.0 / k
    else:
        chance, start = F.transform("scores", lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s))), 0.5
    hit = [F.when(F.col(label) == name, 1.0).otherwise(0.0) for name in model.labels]
    rows = scored.select(
        F.explode(F.arrays_zip("indices", "weights")).alias("e"),
        *[(chance[c] - hit[c]).alias(f"r{c}") for c in range(k)], *[(F.lit(start) - hit[c]).alias(f"z{c}") for c in range(k)])
    w = F.col("e.weights") / F.lit(float(n))
    sums = rows.groupBy(F.col("e.indices").alias("idx")).agg(
        *[F.sum(w * F.col(f"{x}{c}")).alias(f"{x}{c}") for x in "rz" for c in range(k)])
    slopes = sums.join(model.coefficients, "idx", "right").na.fill(0.0, [f"{x}{c}" for x in "rz" for c in range(k)])
    norms = slopes.agg(*[
        F.struct(
            F.lit(model.labels[c]).alias("label"), F.sqrt(F.sum(F.pow(F.col(f"r{c}") + F.lit(penalty) * F.col("coef")[c], F.lit(2.0)))).alias("norm"),
            F.sqrt(F.sum(F.pow(F.col(f"z{c}"), F.lit(2.0)))).alias("start_norm")).alias(f"n{c}")
        for c in range(k)])
    return norms.select(F.explode(F.array(*[f"n{c}" for c in range(k)])).alias("x")).select("x.*")


def log_losses(rows: DataFrame, model: LinearTextModel, label: str = "tag_clean") -> DataFrame:
    """(label, loss): the mean log loss of each class's own sigmoid."""
    scored = score(rows, model, label)
    cells = scored.select(label, F.posexplode("scores").alias("k", "s"))
    names = F.array(*[F.lit(name) for name in model.labels])
    signed = F.when(F.get(names, F.col("k")) == F.col(label), -F.col("s")).otherwise(F.col("s"))
    loss = F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))
    return cells.groupBy(F.get(names, F.col("k")).alias("label")).agg(F.avg(loss).alias("loss"))


def batch_latency(df: DataFrame, run: Callable[[DataFrame], DataFrame]) -> dict:
    """Time one action that consumes every result of ``run``, and counts the rows on its way; milliseconds per row."""
    seen = Observation()
    made = run(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    start = time.perf_counter()
    made.write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    rows = seen.get["rows"]
    return {"n_rows": rows, "seconds": seconds, "ms_per_claim": seconds / max(rows, 1) * 1000}


@dataclass
class TrainingTable:
    """Features of all rows of a split table; ``vectors`` is the same table as ML vectors, if asked for."""

    vectoriser: Vectoriser
    labels: list[str]
    arrays: DataFrame
    vectors: DataFrame | None = None


def prepare_training(
    split: DataFrame, size: int, stop_words: Sequence[str], masks: Sequence[str] = tuple(MASKS_TRAINING),
    vectors: bool = True,
) -> TrainingTable:
    """Fit encoder and vectoriser on the train side only, and turn every row into features.

    Texts are tokenised once; the vocabulary and the counts of every row come from the tokens.  The counts
    are written once; idf, weights and both readings of the features come from them.
    """
    words = [*stop_words, *masks]
    keep = ["claim_id", "tag_clean", "split", *(["in_sample"] if "in_sample" in split.columns else [])]
    is_train = F.col("split") == "train"
    vocabulary, counted = _counted(split.select(*keep, "claim"), is_train, size, words)
    vectoriser = Vectoriser(vocabulary, materialise(idf_smooth(counted.where(is_train)), "idf"), words)
    weighted = weight_arrays(counted, vectoriser.idf)
    if not vectors:
        return TrainingTable(vectoriser, class_names(counted.where(is_train)), weighted)
    encoder = fit_label_encoder(counted.where(is_train))
    as_vectors, arrays = write_features(weighted, len(vocabulary))
    return TrainingTable(vectoriser, list(encoder.labels), arrays, encode_labels(as_vectors, encoder))


def train_all(table: TrainingTable) -> list[LinearTextModel]:
    """The three classifiers in their fixed order, each with its training time; the solvers keep the rows themselves, one at a time."""
    train_arrays = table.arrays.where("split = 'train'")
    train_vectors = table.vectors.where("split = 'train'").select("features", "label")
    models = []
    for fit in (
        lambda: train_logistic(train_vectors, table.vectoriser, table.labels),
        lambda: train_naive_bayes(train_arrays, table.vectoriser, table.labels),
        lambda: train_linear_sgd(train_vectors, table.vectoriser, table.labels),
    ):
        start = time.perf_counter()
        model = fit()
        model.facts["train_s"] = time.perf_counter() - start
        models.append(model)
    return models


def compare_models(table: TrainingTable, models: Sequence[LinearTextModel] | None = None) -> DataFrame:
    """One row per model: accuracy and weighted F1 on sample and full test, seconds, ms per claim of the test side.

    Rows are scored once per model for the counts; the sample is a subset of the test side.
    """
    spark = table.arrays.sparkSession
    models = list(models) if models is not None else train_all(table)
    test = table.arrays.where("split = 'test'")
    scored, facts = None, []
    for order, model in enumerate(models):
        model.matrix  # loaded before the clock starts, as the features are
        timing = batch_latency(test, lambda df, m=model: score(df, m, "claim_id"))
        facts.append((order, model.name, float(model.facts.get("train_s", 0.0)), timing["ms_per_claim"]))
        part = score(test, model, "claim_id", "tag_clean", "in_sample").select(
            F.lit(model.name).alias("model"), F.col("tag_clean").alias("y_true"), F.col("predicted").alias("y_pred"),
            "in_sample",
        )
        scored = part if scored is None else scored.unionByName(part)
    counts = materialise(confusion_counts(scored, "model", "in_sample"), "confusion")

    def summary(cells: DataFrame, suffix: str) -> DataFrame:
        cells = cells.groupBy("model", "y_true", "y_pred").agg(F.sum("n").alias("n"))
        report = weighted_average(per_class_report(cells, "model"), "model")
        return accuracy(cells, "model").join(report, "model").select(
            "model", F.col("accuracy").alias(f"acc_{suffix}"), F.col("weighted_f1").alias(f"f1_{suffix}")
        )

    names = spark.createDataFrame(facts, "model_order int, model string, train_s double, ms_per_claim double")
    return (
        names.join(summary(counts.where("in_sample"), "sample"), "model").join(summary(counts, "full"), "model")
        .select("model_order", "model", "acc_sample", "f1_sample", "acc_full", "f1_full", "train_s", "ms_per_claim")
    )


def evaluation_report(predictions: DataFrame, model: LinearTextModel, ms_per_claim: float, stamp: str) -> DataFrame:
    """The report document as one nested row; averages appear as entries next to the classes."""
    counts = materialise(confusion_counts(predictions), "confusion")
    report = per_class_report(counts)
    total = accuracy(counts)
    cell = "struct<precision:double,recall:double,f1:double,support:bigint>"
    plain = report.select("label", F.struct("precision", "recall", "f1", "support").cast(cell).alias("cell"))
    macro = report.agg(F.struct(F.avg("precision"), F.avg("recall"), F.avg("f1"), F.sum("support")).cast(cell).alias("cell"))
    mean = weighted_average(report)
    weighted = mean.select(
        F.struct("weighted_precision", "weighted_recall", "weighted_f1", total.select("total").scalar()).cast(cell).alias("cell")
    )
    entries = plain.unionByName(macro.select(F.lit("macro avg").alias("label"), "cell")).unionByName(
        weighted.select(F.lit("weighted avg").alias("label"), "cell")
    )
    classes = F.array(*[F.lit(name) for name in model.labels])
    acc, f1 = F.col("accuracy"), mean.select("weighted_f1").scalar()
    return entries.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "cell")))).alias("classification_report")
    ).withColumn("accuracy", total.select("accuracy").scalar()).select(
        F.lit(model.name).alias("model_name"), F.lit(f"{model.name} + TF-IDF").alias("algorithm"),
        F.lit("pyspark").alias("framework"), F.lit("parquet").alias("export_format"),
        F.lit(stamp).alias("timestamp_utc"),
        total.select("total").scalar().cast("int").alias("evaluation_sample_size"),
        F.struct(
            F.round(acc, 4).alias("accuracy"),
            F.format_string("%.2f%%", acc * 100).alias("accuracy_percent"),
            F.round(f1, 4).alias("f1_score_weighted"),
            F.lit(round(ms_per_claim, 4)).alias("inference_latency_ms_per_ticket"),
            F.lit(round(ms_per_claim / 1000, 6)).alias("inference_latency_sec_per_ticket"),
        ).alias("metrics"),
        classes.alias("target_classes"), "classification_report",
    )
