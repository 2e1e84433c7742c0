"""Queries of the evaluation: reports over predictions with planted errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift.operators import metrics
from claimsift.plans.tables import PREDICTIONS_A, PREDICTIONS_B, planted, planted_sql, table
from claimsift.session import new_path
from claimsift.sources.splits import read_predictions, write_predictions


def _engine(spark, sf, columns):
    return planted(table(spark, sf, "documents"), columns)


def _a(spark, sf):
    return _engine(spark, sf, PREDICTIONS_A)


def _b(spark, sf):
    return _engine(spark, sf, PREDICTIONS_B)


def _counts(spark, sf):
    return metrics.confusion_counts(_a(spark, sf))


def _report(spark, sf):
    return metrics.per_class_report(_counts(spark, sf))


def _both(spark, sf):
    return _a(spark, sf).withColumn("engine", F.lit("a")).unionByName(_b(spark, sf).withColumn("engine", F.lit("b")))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def confusion_grid_wide(spark, sf):
    counts = _counts(spark, sf)
    labels = ["Autre / Inconnu", "de", "en", "es", "fr"]
    return metrics.wide_grid(metrics.confusion_grid(counts), labels).withColumnRenamed("Autre / Inconnu", "unknown")


def progress_latency(spark, sf):
    rows = table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("position"), (F.col("value") / 100).alias("latency_sec")
    )
    return metrics.progress_latency(rows)


def pick_best(spark, sf):
    both = _both(spark, sf)
    cells = metrics.confusion_counts(both, "engine")
    scores = metrics.weighted_average(metrics.per_class_report(cells, "engine"), "engine").select(
        "engine", F.round("weighted_f1", 6).alias("f1_sample"), F.when(F.col("engine") == "a", 0).otherwise(1).alias("model_order")
    )
    return metrics.pick_best(scores)


def predictions_round_trip(spark, sf):
    path = new_path(spark, "predictions")
    rows = _a(spark, sf).select(
        "claim_id", F.col("y_true").alias("tag_clean"), F.concat(F.lit(" "), "y_pred").alias("prediction_raw"),
        "latency_sec", F.col("y_pred").alias("prediction"),
    )
    write_predictions(rows, path)
    return read_predictions(spark, path)


QUERIES = {
    "confusion_counts": _counts,
    "confusion_grid": lambda s, d: metrics.confusion_grid(_counts(s, d)),
    "confusion_grid_wide": confusion_grid_wide,
    "label_union": lambda s, d: metrics.label_union(_counts(s, d)),
    "accuracy": lambda s, d: _rounded(metrics.accuracy(_counts(s, d))),
    "per_class_report": lambda s, d: metrics.per_class_report(_counts(s, d), digits=6),
    "macro_average": lambda s, d: _rounded(metrics.macro_average(_report(s, d))),
    "weighted_average": lambda s, d: _rounded(metrics.weighted_average(_report(s, d))),
    "latency_stats": lambda s, d: _rounded(metrics.latency_stats(_a(s, d))),
    "progress_latency": progress_latency,
    "engine_comparison": lambda s, d: metrics.engine_comparison(_a(s, d), _b(s, d)),
    "f1_by_class_comparison": lambda s, d: metrics.f1_by_class_comparison(_both(s, d), "a", "b"),
    "pick_best": pick_best,
    "predictions_round_trip": predictions_round_trip,
}

A = planted_sql("a", PREDICTIONS_A)
B = planted_sql("b", PREDICTIONS_B)
LABELS = "labels AS (SELECT y_true AS label FROM {0} UNION SELECT y_pred FROM {0})"


def report_sql(source: str, name: str = "report") -> str:
    """Per-class report straight from the rows."""
    return f"""
{name} AS (
  SELECT label, CASE WHEN pred = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / pred END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
         CAST(2 * tp AS DOUBLE) / (pred + support) AS f1, support
  FROM (SELECT label, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS pred,
               count(*) FILTER (y_true = label AND y_pred = label) AS tp
        FROM (SELECT y_true AS label FROM {source} UNION SELECT y_pred FROM {source}), {source} GROUP BY label))"""


ORACLES = {
    "confusion_counts": f"WITH {A} SELECT y_true, y_pred, count(*) AS n FROM a GROUP BY ALL",
    "confusion_grid": f"""WITH {A}, {LABELS.format("a")}
SELECT t.label AS y_true, p.label AS y_pred, (SELECT count(*) FROM a WHERE y_true = t.label AND y_pred = p.label) AS n
FROM labels t, labels p""",
    "confusion_grid_wide": f"""WITH {A}, {LABELS.format("a")}
SELECT label AS y_true, count(*) FILTER (y_true = label AND y_pred = 'Autre / Inconnu') AS unknown,
       count(*) FILTER (y_true = label AND y_pred = 'de') AS de, count(*) FILTER (y_true = label AND y_pred = 'en') AS en,
       count(*) FILTER (y_true = label AND y_pred = 'es') AS es, count(*) FILTER (y_true = label AND y_pred = 'fr') AS fr
FROM labels, a GROUP BY label""",
    "label_union": f"WITH {A}, {LABELS.format('a')} SELECT label FROM labels",
    "accuracy": f"""WITH {A} SELECT count(*) FILTER (y_true = y_pred) AS correct, count(*) AS total,
  round(avg(CASE WHEN y_true = y_pred THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy FROM a""",
    "per_class_report": f"""WITH {A}, {report_sql("a")}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""",
    "macro_average": f"""WITH {A}, {report_sql("a")} SELECT round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM report""",
    "weighted_average": f"""WITH {A}, {report_sql("a")}
SELECT round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report""",
    "latency_stats": f"""WITH {A} SELECT round(avg(latency_sec), 6) AS mean_sec,
  round(quantile_cont(latency_sec, 0.5), 6) AS median_sec FROM a""",
    "progress_latency": """WITH r AS (SELECT event_id + 1 AS p, value / 100 AS l, count(*) OVER () AS n FROM events),
w AS (SELECT p, n, avg(l) OVER (ORDER BY p ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS m FROM r)
SELECT p AS done, round(p * CAST(100 AS DOUBLE) / n, 6) AS pct_done, round(m, 6) AS mean_latency FROM w WHERE p % 25 = 0 OR p = n""",
    "engine_comparison": f"""WITH {A}, {B}, {report_sql("a", "ra")}, {report_sql("b", "rb")},
s AS (SELECT (SELECT count(*) FROM a) AS n,
  (SELECT avg(CASE WHEN y_true = y_pred THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM a) AS aa,
  (SELECT avg(CASE WHEN y_true = y_pred THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM b) AS ab,
  (SELECT sum(f1 * support) / sum(support) FROM ra) AS fa, (SELECT sum(f1 * support) / sum(support) FROM rb) AS fb,
  (SELECT avg(latency_sec) FROM a) AS la, (SELECT avg(latency_sec) FROM b) AS lb)
SELECT n, round(aa, 6) AS accuracy_a, round(ab, 6) AS accuracy_b, round(fa, 6) AS f1_a, round(fb, 6) AS f1_b,
  round(la, 6) AS latency_a, round(lb, 6) AS latency_b, round((aa - ab) * 100, 6) AS accuracy_points,
  round(lb / la, 6) AS speed_ratio FROM s""",
    "f1_by_class_comparison": f"""WITH {A}, {B}, {report_sql("a", "ra")}, {report_sql("b", "rb")}
SELECT label, round(coalesce(ra.f1, 0), 6) AS f1_a, round(coalesce(rb.f1, 0), 6) AS f1_b,
  round(coalesce(ra.f1, 0) - coalesce(rb.f1, 0), 6) AS f1_difference FROM ra FULL JOIN rb USING (label)""",
    "pick_best": f"""WITH {A}, {B}, {report_sql("a", "ra")}, {report_sql("b", "rb")}
SELECT engine, f1_sample, CAST(model_order AS INT) AS model_order FROM (
  SELECT 'a' AS engine, round(sum(f1 * support) / sum(support), 6) AS f1_sample, 0 AS model_order FROM ra UNION ALL
  SELECT 'b', round(sum(f1 * support) / sum(support), 6), 1 FROM rb) ORDER BY f1_sample DESC, model_order LIMIT 1""",
    "predictions_round_trip": f"""WITH {A} SELECT claim_id, y_true AS tag_clean, concat(' ', y_pred) AS prediction_raw,
  latency_sec, y_pred AS prediction FROM a""",
}
