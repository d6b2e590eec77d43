"""Reports against published tables, and their edge cases."""

import pytest
from pyspark.sql import functions as F

from wavemill.operators import report
from wavemill.sources.tabular import RESULTS_SCHEMA, read_csv, write_csv, write_results

TASKS = [
    "imagery_audio_closed",
    "imagery_audio_open",
    "imagery_text",
    "imagery_visual",
    "observed_visual",
    "real_audio_closed",
    "real_audio_open",
    "real_text",
    "real_visual",
]
# Published accuracies by task, as (csp, parafac).
BEST = {
    "data_b": [
        (0.717, 0.695), (0.684, 0.677), (0.722, 0.897), (0.706, 0.673), (0.678, 0.657),
        (1.0, 1.0), (1.0, 1.0), (0.997, 0.963), (0.998, 0.994),
    ],
    "data_s": [
        (0.776, 0.641), (0.744, 0.709), (0.787, 0.744), (0.841, 0.886), (0.587, 0.648),
        (0.825, 0.772), (0.984, 0.846), (0.937, 0.807), (0.883, 0.782),
    ],
}
DIFF = {
    "data_b": [0.022, 0.007, -0.175, 0.033, 0.021, 0.0, 0.0, 0.034, 0.004],
    "data_s": [0.135, 0.035, 0.043, -0.045, -0.061, 0.053, 0.138, 0.13, 0.101],
}
BY_TASK = [
    (0.746, 0.668), (0.714, 0.693), (0.754, 0.82), (0.774, 0.78), (0.633, 0.653),
    (0.912, 0.886), (0.992, 0.923), (0.967, 0.885), (0.94, 0.888),
]
BY_FAMILY = {
    ("data_b", "imagery"): 0.721,
    ("data_b", "observation"): 0.668,
    ("data_b", "real"): 0.994,
    ("data_s", "imagery"): 0.766,
    ("data_s", "observation"): 0.617,
    ("data_s", "real"): 0.854,
}


@pytest.fixture(scope="module")
def best(spark):
    rows = [
        (p, t, c, v)
        for p, values in BEST.items()
        for t, pair in zip(TASKS, values)
        for c, v in zip(("csp", "parafac"), pair)
    ]
    return spark.createDataFrame(
        rows, "participant string, task string, classifier string, accuracy double"
    ).cache()


def test_difference(best):
    got = {(r.participant, r.task): r["diff"] for r in report.method_difference(best).collect()}
    assert got == {(p, t): d for p, ds in DIFF.items() for t, d in zip(TASKS, ds)}


def test_by_task(best):
    got = {(r.task, r.classifier): r.accuracy for r in report.mean_over_participants(best).collect()}
    assert got == {
        (t, c): v for t, pair in zip(TASKS, BY_TASK) for c, v in zip(("csp", "parafac"), pair)
    }


def test_by_family(best):
    got = {(r.participant, r.type): r.accuracy for r in report.mean_by_family(best).collect()}
    assert got == BY_FAMILY


def test_unmatched_method(best):
    alone = best.filter("NOT (task = 'real_text' AND classifier = 'parafac')")
    diff = report.method_difference(alone).filter("task = 'real_text'")
    assert [r["diff"] for r in diff.collect()] == [None, None]
    with pytest.raises(Exception, match="no other method"):
        report.method_difference(alone, strict=True).collect()


def result_rows(spark, accuracies, **changes):
    base = ("p", "t", "d", "csp", 0.0, 1.0, "c", 2, 3)
    rows = []
    for i, a in enumerate(accuracies):
        row = list(base)
        row[4], row[5] = a, float(i)
        for k, v in changes.items():
            row[report.KEYS.index(k) if k != "date" else 2] = v
        rows.append(tuple(row))
    return spark.createDataFrame(rows, RESULTS_SCHEMA)


def test_top_skips_nan_and_takes_small_groups_whole(spark):
    df = result_rows(spark, [float("nan"), 0.5, 0.25, None])
    got = report.topk_mean(report.mean_over_splits(df)).collect()
    assert [r.accuracy for r in got] == [0.375]


def test_top_takes_twenty(spark):
    df = result_rows(spark, [i / 100 for i in range(30)])
    assert report.topk_mean(report.mean_over_splits(df)).first().accuracy == 0.195


def test_null_keys(spark):
    df = result_rows(spark, [0.5], date=None)
    assert report.drop_matching_keep_null(df, "date", "2023").count() == 1
    assert report.mean_over_splits(df).count() == 0


def test_top_reduces_before_the_shuffle(spark):
    df = result_rows(spark, [0.1, 0.2])
    plan = report.topk_mean(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_csv_round_trip(spark, best, tmp_path):
    path = str(tmp_path / "best")
    write_csv(best, path, ["participant", "task", "classifier"])
    back = read_csv(spark, path, "participant string, task string, classifier string, accuracy double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, best.collect()))


def test_results_sink(spark, tmp_path):
    path = str(tmp_path / "results")
    write_results(result_rows(spark, [0.5, 0.75]), path)
    back = spark.read.parquet(path).filter(F.col("participant") == "p")
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(participant" in back._jdf.queryExecution().toString()


def test_reports(spark):
    parts = [result_rows(spark, [0.5, 0.7], date="2023-02-24T18-08-13"), result_rows(spark, [0.25])]
    out = report.reports(report.union_results(parts), "2023-02-24T18-08-13")
    assert [r.accuracy for r in out["best"].collect()] == [0.25]
    assert [r["diff"] for r in out["difference"].collect()] == [None]
