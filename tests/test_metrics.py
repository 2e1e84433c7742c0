import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsift.operators import metrics, profile

# A: perfect.  B: never predicted.  C: partly right.  D: never true.  Unknown answers count as a label.
GOLDEN = (
    [("A", "A")] * 4 + [("B", "C")] * 2 + [("B", "Autre / Inconnu")] + [("C", "C")] * 3 + [("C", "D")] + [("C", "A")]
)


@pytest.fixture(scope="module")
def counts(spark):
    return metrics.confusion_counts(spark.createDataFrame(GOLDEN, "y_true string, y_pred string"))


def test_golden_report(counts):
    rows = {r["label"]: r for r in metrics.per_class_report(counts).collect()}
    expected = {  # precision, recall, f1, support
        "A": (4 / 5, 1.0, 8 / 9, 4), "B": (0.0, 0.0, 0.0, 3), "C": (3 / 5, 3 / 5, 3 / 5, 5),
        "D": (0.0, 0.0, 0.0, 0), "Autre / Inconnu": (0.0, 0.0, 0.0, 0),
    }
    assert set(rows) == set(expected)
    for label, (p, r, f, s) in expected.items():
        row = rows[label]
        assert (row["precision"], row["recall"], row["f1"]) == pytest.approx((p, r, f)) and row["support"] == s


def test_golden_averages(counts):
    report = metrics.per_class_report(counts)
    assert metrics.accuracy(counts).first()["accuracy"] == pytest.approx(7 / 12)
    macro = metrics.macro_average(report).first()
    assert macro["macro_f1"] == pytest.approx((8 / 9 + 3 / 5) / 5)
    weighted = metrics.weighted_average(report).first()
    assert weighted["weighted_recall"] == pytest.approx(7 / 12)  # accuracy is the weighted recall
    assert weighted["weighted_f1"] == pytest.approx((8 / 9 * 4 + 3 / 5 * 5) / 12)


def test_grid_is_square_and_complete(counts):
    grid = metrics.confusion_grid(counts).collect()
    assert len(grid) == 25 and sum(r["n"] for r in grid) == 12
    wide = metrics.wide_grid(metrics.confusion_grid(counts), ["A", "B", "C", "D"]).collect()
    assert {r["y_true"]: [r[c] for c in "ABCD"] for r in wide}["C"] == [1, 0, 3, 1]


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [5.0, 1.0, 3.0], [2.0] * 9 + [7.0], list(np.random.default_rng(1).lognormal(0, 3, 1001)),
    [0.0] * 400 + list(np.random.default_rng(2).normal(0, 1, 600)),
])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, monkeypatch, values, q):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [*values, None]], "x double")
    for buckets in (2, 1024):
        monkeypatch.setattr(metrics, "BUCKETS", buckets)
        found = metrics.exact_quantile(df, "x", q).first()["quantile"]
        assert found == pytest.approx(float(np.quantile(values, q)), rel=1e-12, abs=1e-12)
    assert metrics.exact_quantile(df.where("x IS NULL"), "x", q).first()["quantile"] is None


@pytest.mark.parametrize("n", [1, 24, 25, 26, 50, 63])
def test_progress(spark, n):
    values = [math.sin(i) + 2 for i in range(n)]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "position bigint, latency_sec double")
    rows = sorted(metrics.progress_latency(df).collect(), key=lambda r: r["done"])
    ends = [i for i in range(1, n + 1) if i % 25 == 0 or i == n]
    assert [r["done"] for r in rows] == ends
    for r, end in zip(rows, ends, strict=True):
        assert r["mean_latency"] == pytest.approx(np.mean(values[:end][-25:]), abs=1e-6)


def test_first_model_wins_ties(spark):
    df = spark.createDataFrame([(0, "a", 0.8), (1, "b", 0.9), (2, "c", 0.9)], "model_order int, model string, f1_sample double")
    assert metrics.pick_best(df).first()["model"] == "b"


def test_histogram_and_density_edges(spark):
    same = spark.createDataFrame([(7,)] * 5, "word_count int")
    bins = profile.length_histogram(same, 50).collect()
    assert len(bins) == 50 and sum(r["n"] for r in bins) == 5
    assert {r["bin"]: r["n"] for r in bins}[25] == 5
    assert profile.length_density(same).count() == 0
    values = [int(v) for v in np.random.default_rng(3).integers(1, 1000, 700)]
    df = spark.createDataFrame([(v,) for v in values], "word_count int")
    found = [r["n"] for r in sorted(profile.length_histogram(df, 50).collect(), key=lambda r: r["bin"])]
    assert found == np.histogram(values, bins=50)[0].tolist()
    curve = sorted(profile.length_density(df).collect(), key=lambda r: r["point"])
    area = np.trapezoid([r["density"] for r in curve], [r["x"] for r in curve])
    width = (max(values) - min(values)) / 50
    assert 0.9 * 700 * width < area < 700 * width


def test_box_stats_golden(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 5)], "tag_clean string, word_count int")
    row = profile.length_box_stats(df).collect()
    assert len(row) == 1
    r = row[0].asDict()
    assert (r["q1"], r["median"], r["q3"]) == (3.25, 5.5, 7.75)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"], r["n"]) == (1.0, 9.0, 1, 10)


def test_profile_one_row_per_column(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in profile.profile_table(df).orderBy("position").collect()] == [(0, "a", 2, 2), (1, "b", 1, 2)]
    assert df.select(F.lit(1)).count() == 2
