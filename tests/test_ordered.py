"""Ordered operators: the block way gives what a plain window gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.operators import ordered, throttle


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows; one key, NULL among them, holds a third, and order values tie."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 50 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
        .alias("k"),
        (F.hash("id") % 40).alias("t"),
        "id",
    ).repartition(8, "id")


def collect(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("kind", ["int", "double", "string", "timestamp"])
def test_number_rows(rows, kind):
    rows = rows.withColumn("t", F.col("t").cast(kind) if kind != "timestamp" else F.timestamp_seconds(F.col("t") * 600))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = rows.withColumn("n", F.row_number().over(w).cast("long") - 1)
    got = ordered.number_rows(rows, ["k"], ["t", "id"], "n")
    assert collect(got, "k", "t", "id", "n") == collect(want, "k", "t", "id", "n")


@pytest.mark.parametrize("kind", ["decimal(12,2)", "double", "float"])
def test_number_rows_of_decimals_and_odd_numbers(spark, kind):
    values = ["-3", "9.5", "10.5", "20", "100", "-0.25", "1000000.5"]
    if "decimal" not in kind:
        values += ["NaN", "Infinity", "-Infinity", "1e18"]
    df = spark.createDataFrame([("k", v) for v in [*values, None]], "k string, v string").withColumn("v", F.col("v").cast(kind))
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("long") - 1)
    assert list(map(str, collect(ordered.number_rows(df, ["k"], ["v"], "n"), "v", "n"))) == list(map(str, collect(want, "v", "n")))
    with pytest.raises(TypeError):
        ordered.number_rows(df.withColumn("b", F.lit(True)), ["k"], ["b"])


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_previous_and_total(rows, block):
    w = Window.partitionBy("k").orderBy("n")
    placed = ordered.number_rows(rows, ["k"], ["t", "id"], "n")
    want = placed.withColumn("p", F.lag("id").over(w)).withColumn(
        "s", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    got = ordered.total_before(
        ordered.previous_value(placed, ["k"], "n", "id", "p", block), ["k"], "n", "t", "s", block
    )
    assert collect(got, "k", "id", "p", "s") == collect(want, "k", "id", "p", "s")


def play_in_order(pdf):
    """Reference: one pass over a key."""
    out, busy, last = [], None, None
    for e, t, c, d in zip(pdf["event_id"], pdf["t"], pdf["command"], pdf["playing_s"]):
        if (busy is None or t >= busy) and c != last:
            busy, last = t + d, c
            out.append(e)
    return out


@pytest.mark.parametrize("block", [1, 13, 100, 10**6])
def test_throttle(spark, monkeypatch, block):
    """Blocks played at the same time equal one pass, one hot key with many of them; times tie and some commands take none."""
    monkeypatch.setattr(throttle, "FAN", 4)
    rng = np.random.RandomState(7)
    n = 900
    pdf = pd.DataFrame(
        {
            "key": np.where(rng.rand(n) < 0.6, 0, rng.randint(1, 5, n)),
            "event_id": np.arange(n),
            "t": np.sort(rng.randint(0, 500, n)),
            "command": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]),
            "playing_s": rng.choice([0.0, 1.0, 4.0, 30.0], n),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("t"))
    got = throttle.throttle(df, block).select("event_id").collect()
    want = [e for _, group in pdf.groupby("key") for e in play_in_order(group)]
    assert sorted(r.event_id for r in got) == sorted(want)
