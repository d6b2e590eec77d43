"""Linear discriminant and truncated SVD on feature arrays, by sufficient statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import solve
from wavemill.functions.scalars import dot
from wavemill.operators.apply import matrix, one_width, with_model
from wavemill.operators.signal import fixed_lists
from wavemill.operators.spatial import schema_with, vector_sum


def outer_product(column: str):
    """x x' of an array column, flat."""
    return F.flatten(
        F.transform(column, lambda a: F.transform(column, lambda b: a * b))
    )


def lda_statistics(features: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sum of x and sum of x x' per key and class."""
    return (
        features.withColumn("_xx", outer_product("features"))
        .groupBy(*keys, "class_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            vector_sum("features").alias("sums"),
            vector_sum("_xx").alias("squares"),
        )
    )


def lda_fit(statistics: DataFrame, keys: list[str]) -> DataFrame:
    """One model row per key: an array of (class_id, coef, intercept)."""
    types = dict(statistics.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class_id")
        sums = np.stack(pdf["sums"].to_list())
        squares = np.stack(pdf["squares"].to_list()).sum(axis=0).reshape(sums.shape[1], -1)
        coef, intercept = solve.discriminant(pdf["n"].to_numpy(float), sums, squares)
        classes = [
            {"class_id": int(c), "coef": w.tolist(), "intercept": float(b)}
            for c, w, b in zip(pdf["class_id"], coef, intercept)
        ]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "classes": classes}])

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return statistics.groupBy(*keys).applyInPandas(
        fit, f"{schema}, classes array<struct<class_id:int, coef:array<double>, intercept:double>>"
    )


def linear_score(features: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Class with the largest linear score; the smaller class wins a tie."""
    scored = F.transform(
        "classes",
        lambda m: F.struct(
            (dot(F.col("features"), m["coef"]) + m["intercept"]).alias("score"),
            (-m["class_id"]).alias("minus"),
        ),
    )
    return (
        features.join(models, keys)
        .withColumn("_best", F.array_max(scored))
        .withColumn("predicted", -F.col("_best.minus"))
        .withColumn("score", F.col("_best.score"))
        .drop("_best", "classes")
    )


def feature_gram(features: DataFrame, keys: list[str]) -> DataFrame:
    """Uncentred Gram matrix of the feature rows per key, flat."""
    return (
        features.withColumn("_xx", outer_product("features"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), vector_sum("_xx").alias("gram"))
    )


def svd_basis(grams: DataFrame, keys: list[str], n_components: int = 10) -> DataFrame:
    """Leading right-singular vectors per key."""
    types = dict(grams.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.asarray(pdf["gram"].iloc[0])
        width = int(np.sqrt(len(g)))
        rows = solve.leading_directions(g.reshape(width, width), n_components)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "basis": rows.tolist()}])

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return grams.groupBy(*keys).applyInPandas(fit, f"{schema}, basis array<array<double>>")


def svd_project(features: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates of the feature rows in the basis of their key."""

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        vectors = np.array(models.column("basis")[0].as_py())
        at = rows.schema.get_field_index("features")
        out = [
            piece.set_column(at, "features", fixed_lists(matrix(piece, "features") @ vectors.T))
            for piece in one_width(rows, "features")
        ]
        return pa.concat_tables(out)

    return with_model(features, basis, keys, run, schema_with(features))
