import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimsift.operators import features, metrics, models
from claimsift.operators.models import LinearTextModel, TrainingTable, Vectoriser
from claimsift.operators.sampling import row_hash
from claimsift.plans.tables import STOPS, split_table
from claimsift.sources import reports
from claimsift.sources.model_store import load_model, load_or_train_model, refuse_training_metrics, save_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    return split_table(spark, SF, sample=True)


@pytest.fixture(scope="module")
def table(split):
    return models.prepare_training(split, 5000, STOPS)


@pytest.fixture(scope="module")
def fitted(table):
    return models.train_all(table)


def _accuracy(table, model):
    scored = models.score(table.arrays.where("split = 'test'"), model, "claim_id", "tag_clean")
    counts = metrics.confusion_counts(scored.select(F.col("tag_clean").alias("y_true"), F.col("predicted").alias("y_pred")))
    return metrics.accuracy(counts).first()["accuracy"]


def test_golden_idf(spark):
    counted = spark.createDataFrame([([0, 1],), ([0],)], "indices array<int>")
    idf = {r["idx"]: r["idf"] for r in features.idf_smooth(counted).collect()}
    assert idf[0] == pytest.approx(1.0) and idf[1] == pytest.approx(1 + math.log(1.5))


def test_golden_weights(spark):
    counted = spark.createDataFrame([(1, [0, 1], [1.0, 3.0]), (2, [], [])], "claim_id int, indices array<int>, counts array<double>")
    idf = spark.createDataFrame([(0, 1.0), (1, 2.0)], "idx int, idf double")
    rows = {r["claim_id"]: r["weights"] for r in features.weight_arrays(counted, idf).collect()}
    raw = np.array([1.0, (1 + math.log(3)) * 2])
    assert rows[1] == pytest.approx((raw / np.linalg.norm(raw)).tolist()) and rows[2] == []


def test_golden_naive_bayes(spark):
    rows = [("c0", [0], [1.0]), ("c0", [0, 1], [2.0, 1.0]), ("c0", [0, 1], [1.0, 1.0]), ("c1", [1], [3.0])]
    df = spark.createDataFrame(rows, "tag_clean string, indices array<int>, weights array<double>")
    vectoriser = Vectoriser(["a", "b"], None, [])
    model = models.train_naive_bayes(df, vectoriser, ["c0", "c1"])
    theta = {r["idx"]: r["coef"] for r in model.coefficients.collect()}
    assert [theta[0][0], theta[1][0]] == pytest.approx([math.log(4.1 / 6.2), math.log(2.1 / 6.2)])
    assert [theta[0][1], theta[1][1]] == pytest.approx([math.log(0.1 / 3.2), math.log(3.1 / 3.2)])
    assert model.intercepts == pytest.approx([math.log(0.75), math.log(0.25)])


def test_rows_without_known_terms_get_the_prior(spark):
    coefficients = spark.createDataFrame([(0, [1.0, 2.0])], "idx int, coef array<double>")
    model = LinearTextModel("m", Vectoriser(["a"], None, []), ["x", "y"], [math.log(0.75), math.log(0.25)], coefficients, "softmax")
    df = spark.createDataFrame([(1, [], []), (2, [0], [1.0])], "claim_id int, indices array<int>, weights array<double>")
    rows = {r["claim_id"]: r for r in models.score(df, model, "claim_id").collect()}
    assert rows[1]["predicted"] == "x" and rows[1]["probabilities"] == pytest.approx([0.75, 0.25])
    tie = LinearTextModel("m", model.vectoriser, ["x", "y"], [1.0, 1.0], coefficients, "softmax")
    assert {r["claim_id"]: r["predicted"] for r in models.score(df, tie, "claim_id").collect()} == {1: "x", 2: "y"}


def test_vectors_and_arrays_agree(table):
    row = table.vectors.orderBy("claim_id").first()
    other = table.arrays.where(F.col("claim_id") == row["claim_id"]).first()
    assert row["features"] == Vectors.sparse(5000, other["indices"], other["weights"])
    assert row["features"].norm(2) == pytest.approx(1.0)


def test_one_scoring_operator_equals_the_ml_model(table):
    train = table.vectors.where("split = 'train'")
    n = train.count()
    ml = LogisticRegression(family="multinomial", regParam=1.0 / n, standardization=False, maxIter=30).fit(train)
    own = LinearTextModel(
        "l", table.vectoriser, table.labels, [float(b) for b in ml.interceptVector],
        models._coefficient_table(train.sparkSession, ml.coefficientMatrix.toArray()), "softmax")
    expected = {r["claim_id"]: r for r in ml.transform(table.vectors.where("split = 'test'")).collect()}
    found = models.score(table.arrays.where("split = 'test'"), own, "claim_id").collect()
    assert len(found) == len(expected)
    for r in found:
        assert r["probabilities"] == pytest.approx(expected[r["claim_id"]]["probability"].toArray().tolist(), abs=1e-9)
        assert r["predicted"] == table.labels[int(expected[r["claim_id"]]["prediction"])]


def test_quality_floors_and_probabilities(table, fitted):
    assert [m.name for m in fitted] == ["Logistic Regression", "Multinomial Naive Bayes", "Linear SVM (SGD)"]
    for model in fitted:
        assert _accuracy(table, model) >= 0.95
        for r in models.score(table.arrays.where("split = 'test'"), model, "claim_id").collect():
            assert sum(r["probabilities"]) == pytest.approx(1.0)


def test_five_terms_beat_the_majority(split):
    small = models.prepare_training(split, 5, STOPS, vectors=False)
    model = models.train_naive_bayes(small.arrays.where("split = 'train'"), small.vectoriser, small.labels)
    sizes = [r["n"] for r in small.arrays.where("split = 'test'").groupBy("tag_clean").agg(F.count("*").alias("n")).collect()]
    assert _accuracy(small, model) >= max(sizes) / sum(sizes) + 0.08


def test_shuffled_labels_learn_nothing(table):
    train = table.arrays.where("split = 'train'")
    labels = sorted((r["h"], r["tag_clean"]) for r in train.select(row_hash("claim_id", "x").alias("h"), "tag_clean").collect())
    ids = sorted((r["h"], r["claim_id"]) for r in train.select(row_hash("claim_id", "y").alias("h"), "claim_id").collect())
    pairs = [(i[1], label[1]) for i, label in zip(ids, labels, strict=True)]
    wrong = train.drop("tag_clean").join(train.sparkSession.createDataFrame(pairs, "claim_id bigint, tag_clean string"), "claim_id")
    model = models.train_naive_bayes(wrong, table.vectoriser, table.labels)
    test = table.arrays.where("split = 'test'").groupBy("tag_clean").count().collect()
    majority = max(r["count"] for r in test) / sum(r["count"] for r in test)
    assert _accuracy(table, model) <= majority + 0.05


def test_unseen_label_is_an_error(spark):
    encoder = features.fit_label_encoder(spark.createDataFrame([("b",), ("a",)], "tag_clean string"))
    assert list(encoder.labels) == ["a", "b"]
    with pytest.raises(Exception, match="(?i)unseen"):
        features.encode_labels(spark.createDataFrame([("z",)], "tag_clean string"), encoder).collect()


def test_comparison_report_and_files(spark, table, fitted, tmp_path):
    out = models.compare_models(table, fitted)
    rows = out.orderBy("model_order").collect()
    assert [r["model"] for r in rows] == [m.name for m in fitted]
    assert all(0.9 <= r["acc_full"] <= 1 and r["ms_per_claim"] > 0 and r["train_s"] > 0 for r in rows)
    assert metrics.pick_best(out).count() == 1
    reports.write_comparison(out, str(tmp_path / "comparison"))
    lines = spark.read.text(str(tmp_path / "comparison")).collect()
    assert lines[0][0].startswith("Modèle,Accuracy (1k LLM),F1-Weighted (1k)") and "%" in lines[1][0] and len(lines) == 4


def test_save_and_load(table, fitted, split, spark, tmp_path):
    for k, model in enumerate(fitted):
        path = str(tmp_path / str(k))
        save_model(model, path)
        loaded = load_model(spark, path)
        assert loaded.labels == model.labels and loaded.link == model.link
        test = split.where("split = 'test'")
        a = {r["claim_id"]: r["scores"] for r in models.score(table.arrays.where("split = 'test'"), model, "claim_id").collect()}
        b = {r["claim_id"]: r["scores"] for r in models.predict(test, loaded, "claim_id").collect()}
        assert a.keys() == b.keys()
        assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_load_or_train_branches(split, spark, tmp_path):
    train, sample = split.where("split = 'train'"), split.where("in_sample")
    path = str(tmp_path / "model")
    model, how = load_or_train_model(spark, path, None, sample, STOPS, sample_size=200)
    assert how == "sample" and len(model.vectoriser.vocabulary) == 200
    with pytest.raises(ValueError):
        refuse_training_metrics(how)
    model, how = load_or_train_model(spark, path, train, sample, STOPS, full_size=300)
    assert how == "train" and len(model.vectoriser.vocabulary) == 300
    refuse_training_metrics(how)
    save_model(model, path)
    assert load_or_train_model(spark, path, train, sample, STOPS)[1] == "saved"
    with pytest.raises(ValueError):
        load_or_train_model(spark, str(tmp_path / "none"), None, None, STOPS)


def test_training_table_without_vectors(split):
    table = models.prepare_training(split, 100, STOPS, vectors=False)
    assert isinstance(table, TrainingTable) and table.vectors is None and table.labels == ["de", "en", "es", "fr"]


def test_a_claim_that_occurs_twice_is_scored_twice_and_nothing_is_shuffled(spark):
    coefficients = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "idx int, coef array<double>")
    model = LinearTextModel("m", Vectoriser(["a", "b"], None, []), ["x", "y"], [0.0, 0.0], coefficients, "softmax")
    df = spark.createDataFrame([(1, [0], [1.0]), (1, [1], [1.0]), (2, [0, 1], [1.0, 1.0])], "claim_id int, indices array<int>, weights array<double>")
    found = models.score(df, model, "claim_id")
    assert sorted((r["claim_id"], r["predicted"], r["scores"]) for r in found.collect()) == [(1, "x", [1.0, 0.0]), (1, "y", [0.0, 2.0]), (2, "y", [1.0, 2.0])]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]
    assert "Join" not in plan and "hashpartitioning" not in plan
    short = LinearTextModel("m", Vectoriser(["a", "b", "c"], None, []), ["x", "y"], [0.0, 0.0], coefficients, "softmax")
    with pytest.raises(Exception, match="coefficients and vocabulary differ"):
        models.score(df, short, "claim_id").collect()
