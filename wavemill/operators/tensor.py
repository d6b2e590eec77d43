"""Rank-R tensor decomposition (CP) of epochs x channels x bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import solve
from wavemill.operators.apply import matrix, with_model
from wavemill.operators.signal import fixed_lists
from wavemill.operators.spatial import schema_with, vector_sum

RANK = 10
SWEEPS = 100
TOL = 1e-8
# Gram matrices a task may hold before it passes its partial sums on.
HELD_CELLS = 20_000_000


def cp_mttkrp(tensor: DataFrame, long: DataFrame, short: DataFrame) -> DataFrame:
    """Matricised tensor times the epoch and bin factors: sum_ef x[e,c,f] A[e,r] F[f,r]."""
    return (
        tensor.join(long, "epoch_id")
        .join(short, ["t", "r"])
        .groupBy("channel", "r")
        .agg(F.sum(F.col("value") * F.col("a") * F.col("f")).alias("m"))
    )


def tensor_gram(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """X'X per key, one row per matrix row.

    Tasks multiply whole batches and pass on partial sums, so what is shuffled does
    not grow with the number of epochs.
    """
    types = dict(epochs.dtypes)

    def run(batches):
        held: dict[tuple, list] = {}

        def flush():
            for key, (channels, gram) in held.items():
                yield pd.DataFrame(
                    {
                        **dict(zip(keys, key)),
                        "n_channels": channels,
                        "i": np.arange(len(gram)),
                        "row": list(gram),
                    }
                )
            held.clear()

        for batch in batches:
            frame = batch[[*keys, "n_channels", "data"]]
            for key, group in frame.groupby(keys, sort=False):
                x = np.stack(group["data"].to_list())
                part = x.T @ x
                if key in held:
                    held[key][1] += part
                else:
                    held[key] = [int(group["n_channels"].iloc[0]), part]
                if sum(g.size for _, g in held.values()) > HELD_CELLS:
                    yield from flush()
        yield from flush()

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    partial = epochs.select(*keys, "n_channels", "data").mapInPandas(
        run, f"{schema}, n_channels int, i int, row array<double>"
    )
    return partial.groupBy(*keys, "n_channels", "i").agg(vector_sum("row").alias("row"))


def cp_factors(
    grams: DataFrame, keys: list[str], rank: int = RANK, sweeps: int = SWEEPS, tol: float = TOL, start=None
) -> DataFrame:
    """CP factors per key from its Gram matrix, of (channels x bins) squared cells.

    ``projection`` maps a flat epoch to its reconstruction factor-wise: epoch -> R
    weights (``q``) -> ``parts`` (R x cells).  ``errors`` lists the relative error.
    """
    types = dict(grams.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        gram = np.stack(pdf["row"].to_list())
        channels = int(pdf["n_channels"].iloc[0])
        bins = len(gram) // channels
        if start is None:
            b, f = solve.cp_start_from_gram(gram, channels, rank)
        else:
            b, f = np.full((channels, rank), start), np.full((bins, rank), start)
        q, b, f, errors = solve.cp_fit(
            lambda v: gram @ v, np.array([np.trace(gram)]), b[None], f[None], sweeps, tol
        )
        return pd.DataFrame(
            [
                {
                    **{k: pdf[k].iloc[0] for k in keys},
                    "q": q[0].reshape(-1).tolist(),
                    "parts": solve.khatri_rao(b[0], f[0]).T.reshape(-1).tolist(),
                    "errors": errors[:, 0].tolist(),
                }
            ]
        )

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return grams.groupBy(*keys).applyInPandas(
        fit, f"{schema}, q array<double>, parts array<double>, errors array<double>"
    )


def cp_reconstruct(epochs: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """Each epoch replaced by its low-rank reconstruction: two small products per row."""

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        x = matrix(rows, "data")
        q = models.column("q")[0].values.to_numpy().reshape(x.shape[1], -1)
        parts = models.column("parts")[0].values.to_numpy().reshape(-1, x.shape[1])
        at = rows.schema.get_field_index("data")
        return rows.set_column(at, "data", fixed_lists(x @ q @ parts))

    return with_model(epochs, factors.select(*keys, "q", "parts"), keys, run, schema_with(epochs))
