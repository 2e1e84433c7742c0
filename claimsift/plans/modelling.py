"""Queries of features and models."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from claimsift import flows
from claimsift.fixed_values import LINEAR_ALPHA, LOGISTIC_C, MASKS_TRAINING, VOCABULARY_FULL
from claimsift.operators import features, metrics, models
from claimsift.operators.models import LinearTextModel, TrainingTable
from claimsift.plans.evaluation import report_sql
from claimsift.plans.tables import STOPS, corpus_sql, documents, sample_sql, sides_sql, split_table, words_sql
from claimsift.session import new_path
from claimsift.sources import reports
from claimsift.sources.model_store import load_model, load_or_train_model, save_model
from claimsift.sources.splits import write_split

SIZE = VOCABULARY_FULL
AT_OPTIMUM = 0.0001  # share of the first gradient that may be left
NEAR_OPTIMUM = 0.05  # the same for the stochastic fit


def _training(spark, sf, size=SIZE, vectors=False, sample=False) -> TrainingTable:
    return models.prepare_training(split_table(spark, sf, sample), size, STOPS, vectors=vectors)


def _train_rows(table: TrainingTable):
    return table.arrays.where("split = 'train'")


def _test_rows(table: TrainingTable):
    return table.arrays.where("split = 'test'")


def _bayes(table: TrainingTable) -> LinearTextModel:
    return models.train_naive_bayes(_train_rows(table), table.vectoriser, table.labels)


def naive_bayes(spark, sf, size=SIZE) -> tuple[TrainingTable, LinearTextModel]:
    table = _training(spark, sf, size)
    return table, _bayes(table)


def _named(spark, vectoriser, df):
    terms = spark.createDataFrame(list(enumerate(vectoriser.vocabulary)), "idx int, term string")
    return df.join(F.broadcast(terms), "idx")  # as long as the vocabulary


def encode_labels(spark, sf):
    rows = documents(spark, sf).select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("tag_clean"))
    encoder = features.fit_label_encoder(rows)
    coded = features.encode_labels(rows, encoder)
    decoded = features.decode_labels(coded, encoder.labels, "label", "decoded")
    return decoded.select("claim_id", "tag_clean", F.col("label").cast("int").alias("code"), "decoded")


def idf_smooth(spark, sf):
    table = _training(spark, sf)
    return _named(spark, table.vectoriser, table.vectoriser.idf).select("term", "df", F.round("idf", 6).alias("idf"))


def term_frequency(spark, sf):
    """Sublinear term frequencies of every row against the vocabulary of the train side."""
    split = split_table(spark, sf)
    train = split.where("split = 'train'")
    vectoriser, _ = models.fit_vectoriser(train.select("claim_id", "claim"), SIZE, STOPS)
    counted = vectoriser.counts(split.select("claim_id", "claim")).withColumnRenamed("counts", "weights")
    rows = _named(spark, vectoriser, features.long_form(counted, "claim_id"))
    return rows.select("claim_id", "term", F.round(F.log("weight") + 1.0, 6).alias("tf"))


def tfidf(spark, sf):
    table = _training(spark, sf)
    rows = _named(spark, table.vectoriser, features.long_form(table.arrays, "claim_id"))
    return rows.select("claim_id", "term", F.round("weight", 6).alias("weight"))


def naive_bayes_coefficients(spark, sf):
    table, model = naive_bayes(spark, sf)
    rows = model.coefficients.select("idx", F.posexplode("coef").alias("k", "theta"))
    names = F.array(*[F.lit(name) for name in table.labels])
    return _named(spark, table.vectoriser, rows).select("term", F.get(names, "k").alias("label"), F.round("theta", 6).alias("theta"))


def _predictions(scored, labels):
    wide = [F.round(F.col("probabilities")[k], 6).alias(f"p_{name}") for k, name in enumerate(labels)]
    return scored.select("claim_id", F.col("tag_clean").alias("y_true"), F.col("predicted").alias("y_pred"), *wide)


def predict_naive_bayes(spark, sf):
    table, model = naive_bayes(spark, sf)
    return _predictions(models.score(_test_rows(table), model, "claim_id", "tag_clean"), table.labels)


def saved_model_predictions(spark, sf):
    """The same through save, load and prediction from text."""
    split = split_table(spark, sf)
    table = models.prepare_training(split, SIZE, STOPS, vectors=False)
    path = new_path(spark, "model")
    save_model(_bayes(table), path)
    model = load_model(spark, path)
    scored = models.predict(split.where("split = 'test'"), model, "claim_id", "tag_clean")
    return _predictions(scored, model.labels)


def _scored_counts(table, model):
    scored = models.score(_test_rows(table), model, "claim_id", "tag_clean")
    return metrics.confusion_counts(scored.select(F.col("tag_clean").alias("y_true"), F.col("predicted").alias("y_pred")))


def evaluate_naive_bayes(spark, sf, size=SIZE):
    """Unique texts to split to TF-IDF to model to per-class report on the held-out side."""
    table, model = naive_bayes(spark, sf, size)
    return metrics.per_class_report(_scored_counts(table, model), digits=6)


def metrics_report(spark, sf):
    """The nested report, written as its JSON document, read back and unfolded."""
    table, model = naive_bayes(spark, sf)
    scored = models.score(_test_rows(table), model, "claim_id", "tag_clean")
    rows = scored.select(F.col("tag_clean").alias("y_true"), F.col("predicted").alias("y_pred"))
    report = models.evaluation_report(rows, model, 0.0, "1970-01-01 00:00:00Z")
    path = new_path(spark, "metrics")
    reports.write_metrics_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    cells = back.select(
        "evaluation_sample_size", F.col("metrics.accuracy").alias("accuracy"),
        F.col("metrics.f1_score_weighted").alias("f1_weighted"), F.explode("classification_report").alias("label", "c"),
    )
    return cells.select(
        "label", F.round("c.precision", 6).alias("precision"), F.round("c.recall", 6).alias("recall"),
        F.round("c.f1", 6).alias("f1"), "c.support", "evaluation_sample_size", "accuracy", "f1_weighted",
    )


def _solver(spark, sf, fit):
    """Predictions of a model whose solver keeps the rows it needs."""
    table = _training(spark, sf, vectors=True)
    model = fit(table.vectors.where("split = 'train'").select("features", "label"), table.vectoriser, table.labels)
    return _predictions(models.score(_test_rows(table), model, "claim_id", "tag_clean"), table.labels)


def logistic_regression(spark, sf):
    return _solver(spark, sf, models.train_logistic)


def linear_ovr(spark, sf):
    return _solver(spark, sf, models.train_linear_ovr)


def linear_sgd(spark, sf):
    return _solver(spark, sf, models.train_linear_sgd)


def linear_sgd_descent(spark, sf):
    """Per class: whether the stochastic fit has left a small gradient and less than half of the first loss."""
    table = _training(spark, sf, vectors=True)
    train = table.vectors.where("split = 'train'").select("features", "label").persist()
    try:
        model = models.train_linear_sgd(train, table.vectoriser, table.labels)
    finally:
        train.unpersist()
    norms = models.gradient_norms(_train_rows(table), model, LINEAR_ALPHA)
    losses = models.log_losses(_train_rows(table), model)
    return norms.join(losses, "label").select(
        "label", (F.col("norm") <= NEAR_OPTIMUM * F.col("start_norm")).alias("near_optimum"), (F.col("loss") < F.log(F.lit(2.0)) / 2).alias("learned"))


def linear_svm(spark, sf):
    return _solver(spark, sf, functools.partial(models.train_linear_ovr, hinge=True))


def compare_models(spark, sf):
    return models.compare_models(_training(spark, sf, vectors=True, sample=True))


def _optimum(spark, sf, fit, penalty):
    """Whether the solver came to the optimum: the gradient is at most a ten-thousandth of what it was at the start."""
    table = _training(spark, sf, vectors=True)
    train = table.vectors.where("split = 'train'").select("features", "label")
    model, n = fit(train, table.vectoriser, table.labels), train.count()
    norms = models.gradient_norms(_train_rows(table), model, penalty(n))
    return norms.select("label", (F.col("norm") <= AT_OPTIMUM * F.col("start_norm")).alias("at_optimum"))


def logistic_optimum(spark, sf):
    return _optimum(spark, sf, models.train_logistic, lambda n: 1.0 / (LOGISTIC_C * n))


def linear_ovr_optimum(spark, sf):
    return _optimum(spark, sf, models.train_linear_ovr, lambda n: LINEAR_ALPHA)


def comparison_round_trip(spark, sf):
    """Train, compare, pick, save and write; the file read back beside what decides it."""
    path, out = new_path(spark, "splits"), new_path(spark, "best")
    write_split(split_table(spark, sf, sample=True), path)
    comparison, best = flows.best_model_export(spark, path, out, STOPS, SIZE)
    first, name = reports.COMPARISON_HEADER[0], load_model(spark, f"{out}/model").name
    file = spark.read.option("header", "true").csv(f"{out}/comparison").withColumnRenamed(first, "model")
    top = comparison.agg(F.max("f1_sample")).scalar()
    rows = comparison.join(file, "model")
    shares = [F.format_string("%.2f%%", F.col(c) * 100) == F.col(f"`{reports.COMPARISON_HEADER[k]}`") for k, c in ((1, "acc_sample"), (3, "acc_full"))]
    return rows.select(
        "model_order", "model", (shares[0] & shares[1]).alias("file_agrees"), F.col("acc_full").between(0.5, 1.0).alias("learned"),
        F.when(F.col("model") == best.name, (F.col("f1_sample") == top) & F.lit(name == best.name)).otherwise(True).alias("best_is_saved"))


def batch_latency(spark, sf):
    """Rows and whether the clock ran; the figures themselves are printed by the bench."""
    split = split_table(spark, sf)
    table = models.prepare_training(split, SIZE, STOPS, vectors=False)
    model = _bayes(table)
    timing = models.batch_latency(split.where("split = 'test'"), lambda df: models.predict(df, model, "claim_id"))
    row = (timing["n_rows"], timing["seconds"] > 0 and timing["ms_per_claim"] > 0)
    return spark.createDataFrame([row], "n_rows bigint, timed boolean")


def load_or_train(spark, sf):
    """No model is saved yet: trains on the train side, saves, and loads what was saved."""
    split = split_table(spark, sf, sample=True)
    path = new_path(spark, "exported")
    train, sample = split.where("split = 'train'"), split.where("in_sample")
    model, first = load_or_train_model(spark, path, train, sample, STOPS, full_size=SIZE)
    save_model(model, path)
    again, second = load_or_train_model(spark, path, train, sample, STOPS, full_size=SIZE)
    scored = models.predict(sample, again, "claim_id", "tag_clean")
    return scored.select("claim_id", "tag_clean", F.lit(first).alias("first"), F.lit(second).alias("second"))


QUERIES = {
    "encode_labels": encode_labels,
    "term_frequency_sublinear": term_frequency,
    "idf_smooth": idf_smooth,
    "tfidf": tfidf,
    "naive_bayes_coefficients": naive_bayes_coefficients,
    "predict_naive_bayes": predict_naive_bayes,
    "saved_model_predictions": saved_model_predictions,
    "evaluate_naive_bayes": evaluate_naive_bayes,
    "evaluate_naive_bayes_5_terms": functools.partial(evaluate_naive_bayes, size=5),
    "metrics_report": metrics_report,
    "logistic_regression": logistic_regression,
    "linear_ovr": linear_ovr,
    "linear_svm": linear_svm,
    "linear_sgd": linear_sgd,
    "linear_sgd_descent": linear_sgd_descent,
    "logistic_regression_optimum": logistic_optimum,
    "linear_ovr_optimum": linear_ovr_optimum,
    "compare_models": compare_models,
    "comparison_round_trip": comparison_round_trip,
    "batch_latency": batch_latency,
    "load_or_train_model": load_or_train,
}


def features_sql(size: int = SIZE) -> str:
    """Corpus to sides to tf, idf and w (weights), in long form."""
    words = words_sql([*STOPS, *MASKS_TRAINING])
    return f"""{corpus_sql()},{sides_sql()},
tok AS (SELECT claim_id, tag_clean, split,
          list_filter(regexp_extract_all(lower(claim), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({words})) AS t FROM sides),
terms AS (SELECT claim_id, tag_clean, split, unnest(t) AS term FROM tok UNION ALL
  SELECT claim_id, tag_clean, split, unnest(list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1]))) FROM tok),
vocab AS (SELECT term FROM terms WHERE split = 'train' GROUP BY term ORDER BY count(*) DESC, term LIMIT {size}),
tf AS (SELECT claim_id, tag_clean, split, term, 1 + ln(count(*)) AS tf FROM terms WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln(CAST(1 + (SELECT count(*) FROM sides WHERE split = 'train') AS DOUBLE) / (1 + count(*))) + 1 AS idf
        FROM tf WHERE split = 'train' GROUP BY term),
w AS (SELECT claim_id, tag_clean, split, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY claim_id)) AS w
      FROM tf JOIN idf USING (term))"""


def bayes_sql(size: int = SIZE) -> str:
    """theta per (term, label), prior, and scored: probabilities and predicted class of every row."""
    return f"""{features_sql(size)},
classes AS (SELECT tag_clean AS label, ln(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()) AS prior FROM sides WHERE split = 'train' GROUP BY 1),
class_total AS (SELECT tag_clean AS label, sum(w) AS total FROM w WHERE split = 'train' GROUP BY 1),
term_class AS (SELECT term, tag_clean AS label, sum(w) AS s FROM w WHERE split = 'train' GROUP BY 1, 2),
theta AS (
  SELECT term, label, ln((coalesce(s, 0) + CAST(0.1 AS DOUBLE)) / (coalesce(total, 0) + CAST(0.1 AS DOUBLE) * (SELECT count(*) FROM vocab))) AS theta
  FROM vocab CROSS JOIN classes LEFT JOIN class_total USING (label) LEFT JOIN term_class USING (term, label)),
raw_score AS (SELECT claim_id, label, sum(w * theta) AS s FROM w JOIN theta USING (term) GROUP BY 1, 2),
score AS (SELECT c.claim_id, c.tag_clean, c.split, k.label, k.prior + coalesce(s, 0) AS s
          FROM sides c CROSS JOIN classes k LEFT JOIN raw_score r ON r.claim_id = c.claim_id AND r.label = k.label),
prob AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY claim_id) AS p,
                row_number() OVER (PARTITION BY claim_id ORDER BY round(s, 9) DESC, label) AS place
         FROM (SELECT *, max(s) OVER (PARTITION BY claim_id) AS m FROM score)),
predicted AS (SELECT claim_id, any_value(tag_clean) AS y_true, any_value(split) AS split, max(label) FILTER (place = 1) AS y_pred,
  round(max(p) FILTER (label = 'de'), 6) AS p_de, round(max(p) FILTER (label = 'en'), 6) AS p_en,
  round(max(p) FILTER (label = 'es'), 6) AS p_es, round(max(p) FILTER (label = 'fr'), 6) AS p_fr FROM prob GROUP BY claim_id),
held_out AS (SELECT * FROM predicted WHERE split = 'test')"""


_PREDICTED = f"WITH {bayes_sql()} SELECT * EXCLUDE (split) FROM held_out"


def _evaluated(size):
    return f"""WITH {bayes_sql(size)},{report_sql("held_out")}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""


_OPTIMUM = f"WITH {corpus_sql()},{sides_sql()} SELECT DISTINCT tag_clean AS label, true AS at_optimum FROM sides WHERE split = 'train'"

ORACLES = {
    "logistic_regression_optimum": _OPTIMUM,
    "linear_ovr_optimum": _OPTIMUM,
    "linear_sgd_descent": f"WITH {corpus_sql()},{sides_sql()} SELECT DISTINCT tag_clean AS label, true AS near_optimum, true AS learned FROM sides WHERE split = 'train'",
    "comparison_round_trip": """SELECT CAST(model_order AS INT) AS model_order, model, true AS file_agrees, true AS learned, true AS best_is_saved
FROM (VALUES (0, 'Logistic Regression'), (1, 'Multinomial Naive Bayes'), (2, 'Linear SVM (SGD)')) v(model_order, model)""",
    "batch_latency": f"WITH {corpus_sql()},{sides_sql()} SELECT count(*) AS n_rows, true AS timed FROM sides WHERE split = 'test'",
    "load_or_train_model": f"""WITH {corpus_sql()},{sides_sql()},{sample_sql()}
SELECT claim_id, tag_clean, 'train' AS first, 'saved' AS second FROM sampled WHERE in_sample""",
    "encode_labels": """SELECT doc_id AS claim_id, lang AS tag_clean, lang AS decoded,
  CAST((SELECT count(DISTINCT b.lang) FROM documents b WHERE b.lang < a.lang) AS INT) AS code FROM documents a""",
    "term_frequency_sublinear": f"WITH {features_sql()} SELECT claim_id, term, round(tf, 6) AS tf FROM tf",
    "idf_smooth": f"WITH {features_sql()} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf": f"WITH {features_sql()} SELECT claim_id, term, round(w, 6) AS weight FROM w",
    "naive_bayes_coefficients": f"WITH {bayes_sql()} SELECT term, label, round(theta, 6) AS theta FROM theta",
    "predict_naive_bayes": _PREDICTED,
    "saved_model_predictions": _PREDICTED,
    "evaluate_naive_bayes": _evaluated(SIZE),
    "evaluate_naive_bayes_5_terms": _evaluated(5),
    "metrics_report": f"""WITH {bayes_sql()},{report_sql("held_out")},
overall AS (SELECT CAST(count(*) AS INT) AS n, round(avg(CASE WHEN y_true = y_pred THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS acc FROM held_out),
weighted AS (SELECT sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
                    sum(f1 * support) / sum(support) AS f1 FROM report),
entries AS (SELECT label, precision, recall, f1, support FROM report
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM report
  UNION ALL SELECT 'weighted avg', precision, recall, f1, (SELECT count(*) FROM held_out) FROM weighted)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support,
       n AS evaluation_sample_size, acc AS accuracy, (SELECT round(f1, 4) FROM weighted) AS f1_weighted FROM entries, overall""",
}
