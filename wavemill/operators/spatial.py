"""Covariances, spatial filters and log-power features.

Everything after the epochs works on their Gram matrices X X': class covariances of
any split are sums of them, and the power of a filtered epoch is w' G w / T.
Samples are read once, however many splits there are.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import solve
from wavemill.operators.apply import matrix, one_width, with_model
from wavemill.operators.events import window_starts
from wavemill.operators.ordered import join_on
from wavemill.operators.signal import fixed_lists, same_shape


def vector_sum(column: str):
    """Element-wise sum of an array column, aggregated map-side."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def replaced(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """Batch with columns replaced or appended."""
    for name, values in columns.items():
        at = batch.schema.get_field_index(name)
        if at >= 0:
            batch = batch.set_column(at, name, values)
        else:
            batch = batch.append_column(name, values)
    return batch


def epoch_gram(epochs: DataFrame) -> DataFrame:
    """Gram matrix of each epoch (flat, channels x channels) and its number of times."""

    def run(batches):
        for batch in batches:
            for part, x in same_shape(batch):
                gram = x @ x.transpose(0, 2, 1)
                times = pa.array(np.full(len(x), x.shape[2]), pa.int32())
                yield replaced(part, data=fixed_lists(gram.reshape(len(x), -1)), n_times=times)

    return epochs.mapInArrow(run, schema_with(epochs, "n_times int"))


def window_gram(epochs: DataFrame, length: int, step: int) -> DataFrame:
    """Gram matrices of the running windows of each epoch.

    Panes of gcd(length, step) times are multiplied once; windows add up panes.
    """
    pane = gcd(length, step)

    def run(batches):
        for batch in batches:
            for part, x in same_shape(batch):
                n, channels, times = x.shape
                starts = window_starts(times, length, step)
                panes = x[:, :, : times // pane * pane].reshape(n, channels, -1, pane)
                panes = panes.transpose(0, 2, 1, 3)
                upto = np.cumsum(panes @ panes.transpose(0, 1, 3, 2), axis=1)
                upto = np.concatenate([np.zeros((n, 1, channels, channels)), upto], axis=1)
                for w, at in enumerate(starts):
                    gram = upto[:, (at + length) // pane] - upto[:, at // pane]
                    yield replaced(
                        part,
                        data=fixed_lists(gram.reshape(n, -1)),
                        n_times=pa.array(np.full(n, length), pa.int32()),
                        window_id=pa.array(np.full(n, w), pa.int32()),
                    )

    return epochs.mapInArrow(run, schema_with(epochs, "n_times int", "window_id int"))


def schema_with(df: DataFrame, *more: str, without: tuple = ()) -> str:
    kept = [f"`{c}` {t}" for c, t in df.dtypes if c not in without]
    return ", ".join([*kept, *more])


def class_covariance(
    grams: DataFrame, splits: DataFrame, n_splits: int, keys: list[str] = ["recording_id"]
) -> DataFrame:
    """Uncentred class covariance of the train epochs of each split.

    Train = all - test, so an epoch enters once for the total and once for each split
    that tests it, in place of once for each split that trains on it.
    """
    sums = [
        vector_sum("data").alias("g"),
        F.sum("n_times").alias("t"),
        F.count(F.lit(1)).alias("n"),
    ]
    tests = splits.filter(F.col("role") == "test").select("recording_id", "epoch_id", "split_id")
    per_class = [*keys, "class_id"]
    tested = (
        grams.join(tests, ["recording_id", "epoch_id"])
        .groupBy(*per_class, "split_id")
        .agg(*sums)
        .select(*per_class, "split_id", *[F.col(c).alias(f"_{c}") for c in "gtn"])
    )
    total = (
        grams.groupBy(*per_class)
        .agg(*sums)
        .withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    )
    times = F.col("t") - F.coalesce("_t", F.lit(0))
    train = F.when(F.col("_g").isNull(), F.col("g")).otherwise(
        F.zip_with("g", "_g", lambda a, b: a - b)
    )
    return (
        join_on(total, tested, [*per_class, "split_id"], "left")
        .withColumn("n", F.col("n") - F.coalesce("_n", F.lit(0)))
        .filter(F.col("n") > 0)
        .select(
            *keys,
            "split_id",
            "class_id",
            "n",
            F.transform(train, lambda v: v / times).alias("cov"),
        )
    )


def csp_filters(
    covariances: DataFrame, keys: list[str] = ["recording_id", "split_id"], n_components: int = 32
) -> DataFrame:
    """Spatial filters per key from its two class covariances.

    A group is one small matrix per class.  A key without exactly two classes gets
    a message in ``error`` and no filters.
    """
    types = dict(covariances.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(filters=None, shares=None, error=None)
        if len(pdf) != 2:
            row["error"] = f"{len(pdf)} classes in the train epochs, 2 needed"
        else:
            a, b = pdf.sort_values("class_id")["cov"]
            width = int(np.sqrt(len(a)))
            w, shares = solve.joint_diagonal(
                np.reshape(a, (width, width)), np.reshape(b, (width, width)), n_components
            )
            row.update(filters=w.reshape(-1).tolist(), shares=shares.tolist())
        return pd.DataFrame([row])

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return covariances.groupBy(*keys).applyInPandas(
        fit, f"{schema}, filters array<double>, shares array<double>, error string"
    )


def csp_log_power(grams: DataFrame, filters: DataFrame, keys: list[str]) -> DataFrame:
    """Log mean power of each filtered component, from the Gram matrix.

    With filters for several splits per key, each row comes out once per split.
    """
    more = [c for c in ("split_id",) if c in filters.columns and c not in keys]
    usable = filters.filter(F.col("filters").isNotNull()).select(*keys, *more, "filters")
    types = dict(filters.dtypes)
    columns = [c for c in grams.columns if c != "data"]
    schema = ", ".join(
        [schema_with(grams, without=("data",)), *[f"{c} {types[c]}" for c in more], "features array<double>"]
    )

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        out = []
        for piece in one_width(rows, "data"):
            flat = matrix(piece, "data")
            channels = int(np.sqrt(flat.shape[1]))
            gram = flat.reshape(-1, channels, channels)
            times = piece.column("n_times").to_numpy()
            for m in range(models.num_rows):
                w = np.reshape(models.column("filters")[m].values.to_numpy(), (-1, channels))
                power = ((w @ gram) * w).sum(axis=2)
                logs = np.log(np.maximum(power, np.finfo(float).tiny) / times[:, None])
                part = piece.select(columns)
                for c in more:
                    value = models.column(c)[m]
                    part = part.append_column(c, pa.repeat(value, len(part)))
                out.append(part.append_column("features", fixed_lists(logs)))
        return pa.concat_tables(out)

    return with_model(grams, usable, keys, run, schema)


def concat_features(features: DataFrame, keys: list[str], band: str = "band_id") -> DataFrame:
    """Features of all bands of an epoch side by side, in band order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(band), F.col("features"))))
    return (
        features.groupBy(*keys)
        .agg(ordered.alias("_b"))
        .select(*keys, F.flatten(F.transform("_b", lambda b: b["features"])).alias("features"))
    )
