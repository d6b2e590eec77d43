"""Registered queries: classifier evaluation."""

from __future__ import annotations

from wavemill.operators import evaluate
from wavemill.plans.sqltext import with_ctes
from wavemill.registry import query
from wavemill.sources import views

N_CLASSES = 3
CLASSES_SQL = f"classes AS (SELECT CAST(c AS INTEGER) AS class_id FROM range({N_CLASSES}) r(c))"
PARTS_SQL = """parts AS (
  SELECT class_id,
    count(*) FILTER (predicted = class_id AND actual = class_id) AS tp,
    count(*) FILTER (actual = class_id) AS actual_cases,
    count(*) FILTER (predicted = class_id) AS predicted_cases
  FROM classes, predictions GROUP BY class_id)"""
CTES = with_ctes(views.PREDICTIONS_SQL, CLASSES_SQL, PARTS_SQL)


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE {n}::DOUBLE / {d} END"


query(
    "accuracy_per_split",
    with_ctes(views.PREDICTIONS_SQL)
    + """SELECT split_id, count(*) FILTER (predicted = actual) AS hits, count(*) AS cases,
  count(*) FILTER (predicted = actual)::DOUBLE / count(*) AS accuracy FROM predictions GROUP BY split_id""",
)(lambda spark, sf: evaluate.accuracy_per_split(views.predictions(spark, sf)))

query(
    "pooled_accuracy",
    with_ctes(views.PREDICTIONS_SQL)
    + "SELECT count(*) FILTER (predicted = actual)::DOUBLE / count(*) AS accuracy FROM predictions",
)(lambda spark, sf: evaluate.pooled_accuracy(views.predictions(spark, sf)))

query(
    "confusion_matrix",
    with_ctes(views.PREDICTIONS_SQL, CLASSES_SQL)
    + """SELECT p.class_id AS predicted, a.class_id AS actual, count(r.epoch_id) AS n
FROM classes p CROSS JOIN classes a
LEFT JOIN predictions r ON r.predicted = p.class_id AND r.actual = a.class_id GROUP BY ALL""",
)(lambda spark, sf: evaluate.confusion_matrix(views.predictions(spark, sf), N_CLASSES))

query(
    "precision_recall",
    CTES
    + f"""SELECT class_id, tp, actual_cases, predicted_cases,
  {ratio('tp', 'predicted_cases')} AS precision, {ratio('tp', 'actual_cases')} AS recall FROM parts""",
)(lambda spark, sf: evaluate.precision_recall(views.predictions(spark, sf), N_CLASSES))

query(
    "micro_precision_recall",
    CTES
    + f"""SELECT {ratio('sum(tp)', 'sum(predicted_cases)')} AS precision,
  {ratio('sum(tp)', 'sum(actual_cases)')} AS recall FROM parts""",
)(lambda spark, sf: evaluate.micro_precision_recall(views.predictions(spark, sf), N_CLASSES))

query(
    "class_accuracy_sentinel",
    CTES
    + """SELECT class_id, CASE WHEN actual_cases = 0 THEN 2.0::DOUBLE
  ELSE tp::DOUBLE / actual_cases END AS accuracy FROM parts""",
)(lambda spark, sf: evaluate.class_accuracy_sentinel(views.predictions(spark, sf), N_CLASSES))
