"""Aggregates of the caller's own, in two phases."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.operators import aggregate, events


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(4)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 5000, p=[0.9, 0.05, 0.05]), "v": rng.randn(5000)})
    pdf.loc[::50, "v"] = np.nan
    pdf.loc[7::400, "k"] = None
    return spark.createDataFrame(pdf).withColumn("v", F.when(F.rand(1) > 0.02, F.col("v"))).cache().repartition(7)


def test_mean_of_largest_in_pieces(rows, monkeypatch):
    """A hot key is summed up in many pieces; NULL is a key of its own."""
    monkeypatch.setattr(aggregate, "ROWS", 100)
    monkeypatch.setattr(aggregate, "STATES", 3)
    got = {r.k: r.m for r in aggregate.aggregate(rows, ["k"], aggregate.mean_of_largest("v", 20, "m")).collect()}
    pdf = rows.toPandas()
    want = {(None if pd.isna(k) else k): g["v"].dropna().nlargest(20).mean() for k, g in pdf.groupby("k", dropna=False)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_keys_without_values_and_no_rows(spark):
    df = spark.createDataFrame([("x", None), ("y", float("nan")), ("z", 2.0)], "k string, v double")
    how = aggregate.mean_of_largest("v", 3, "m")
    assert {r.k: r.m for r in aggregate.aggregate(df, ["k"], how).collect()} == {"x": None, "y": None, "z": 2.0}
    assert aggregate.aggregate(df.limit(0), ["k"], how).count() == 0


def test_state_of_several_columns(rows):
    """Mean and spread from counts, sums and squares."""

    def sums(table):
        v = table.column("v").combine_chunks().drop_null().to_numpy()
        v = v[~np.isnan(v)]
        return pa.table({"n": [len(v)], "s": [v.sum()], "q": [(v * v).sum()]})

    def merge(table):
        return pa.table({c: [sum(table.column(c).to_pylist())] for c in ("n", "s", "q")})

    def finish(state):
        n, s, q = (state.column(c)[0].as_py() for c in ("n", "s", "q"))
        return pa.table({"mean": [s / n], "variance": [(q - s * s / n) / (n - 1)]})

    how = aggregate.Aggregate("n bigint, s double, q double", "mean double, variance double", sums, merge, finish)
    got = {r.k: (r.mean, r.variance) for r in aggregate.aggregate(rows, ["k"], how).collect()}
    fine = rows.filter(~F.isnan("v")).groupBy("k").agg(F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    for r in fine.collect():
        assert np.allclose(got[r.k], (r.m, r.s))


def test_pyramid_levels_follow_from_samples(spark):
    df = spark.range(1000).select(F.lit("r").alias("recording_id"), F.lit("c").alias("channel"), F.col("id").alias("sample_idx"), (F.hash("id") % 97).cast("double").alias("value"))
    out = events.envelope_pyramid(df, 8, F.lit(1), 5)
    for level in range(5):
        want = events.block_envelope(df, 8 * 2**level, F.lit(1))
        got = out.filter(F.col("level") == level).drop("level")
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
