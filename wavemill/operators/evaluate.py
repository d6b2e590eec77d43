"""Classifier evaluation.  Everything derives from (predicted, actual) counts, which
aggregate map-side to a few rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.scalars import safe_ratio
from wavemill.operators.events import relabel_hierarchy


def hit() -> Column:
    return F.col("predicted") == F.col("actual")


def accuracy_per_split(predictions: DataFrame, keys: list[str] = ["split_id"]) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count_if(hit()).alias("hits"),
        F.count(F.lit(1)).alias("cases"),
        F.avg(hit().cast("double")).alias("accuracy"),
    )


def pooled_accuracy(predictions: DataFrame, keys: list[str] = []) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        safe_ratio(F.count_if(hit()), F.count(F.lit(1))).alias("accuracy")
    )


def pair_counts(predictions: DataFrame, keys: list[str] = []) -> DataFrame:
    return predictions.groupBy(*keys, "predicted", "actual").agg(F.count(F.lit(1)).alias("n"))


def class_range(predictions: DataFrame, n_classes: int) -> DataFrame:
    return predictions.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id"))


def confusion_matrix(predictions: DataFrame, n_classes: int) -> DataFrame:
    """Counts over all splits; rows are predictions, columns actual classes, gaps are 0."""
    cell = F.col("id").cast("int")
    grid = predictions.sparkSession.range(n_classes * n_classes).select(
        F.floor(cell / n_classes).cast("int").alias("predicted"),
        (cell % n_classes).alias("actual"),
    )
    return grid.join(pair_counts(predictions), ["predicted", "actual"], "left").select(
        "predicted", "actual", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_parts(predictions: DataFrame, n_classes: int) -> DataFrame:
    """Per class: true positives, actual cases, predicted cases."""
    zero = F.lit(0).cast("long")
    as_actual = F.struct(
        F.col("actual").cast("int").alias("class_id"),
        F.when(hit(), F.col("n")).otherwise(zero).alias("tp"),
        F.col("n").alias("actual_cases"),
        zero.alias("predicted_cases"),
    )
    as_predicted = F.struct(
        F.col("predicted").cast("int").alias("class_id"),
        zero.alias("tp"),
        zero.alias("actual_cases"),
        F.col("n").alias("predicted_cases"),
    )
    parts = ["tp", "actual_cases", "predicted_cases"]
    sums = (
        pair_counts(predictions)
        .select(F.inline(F.array(as_actual, as_predicted)))
        .groupBy("class_id")
        .agg(*[F.sum(c).alias(c) for c in parts])
    )
    return class_range(predictions, n_classes).join(sums, "class_id", "left").fillna(0, parts)


def precision_recall(predictions: DataFrame, n_classes: int) -> DataFrame:
    """Precision and recall per class, pooled over splits, 0 without cases."""
    return class_parts(predictions, n_classes).select(
        "class_id",
        "tp",
        "actual_cases",
        "predicted_cases",
        safe_ratio(F.col("tp"), F.col("predicted_cases")).alias("precision"),
        safe_ratio(F.col("tp"), F.col("actual_cases")).alias("recall"),
    )


def micro_precision_recall(predictions: DataFrame, n_classes: int) -> DataFrame:
    return class_parts(predictions, n_classes).agg(
        safe_ratio(F.sum("tp"), F.sum("predicted_cases")).alias("precision"),
        safe_ratio(F.sum("tp"), F.sum("actual_cases")).alias("recall"),
    )


def class_accuracy_sentinel(predictions: DataFrame, n_classes: int) -> DataFrame:
    """Share of a class predicted right; 2 marks a class without cases."""
    return class_parts(predictions, n_classes).select(
        "class_id",
        F.when(F.col("actual_cases") == 0, F.lit(2.0))
        .otherwise(F.col("tp") / F.col("actual_cases"))
        .alias("accuracy"),
    )


def two_stage_decision(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """0 where the first stage says idle, otherwise the class of the second stage."""
    return (
        first.withColumnRenamed("predicted", "_first")
        .join(second.select(*keys, F.col("predicted").alias("_second")), keys)
        .withColumn("predicted", F.when(F.col("_first") == 0, F.lit(0)).otherwise(F.col("_second")))
        .drop("_first", "_second")
    )


def two_stage_membership(epochs: DataFrame) -> DataFrame:
    """Which stages train on an epoch, keyed by epoch and not by position."""
    return relabel_hierarchy(epochs).select(
        "epoch_id",
        "stage1",
        "stage2",
        F.when(F.col("stage2").isNotNull(), "both").otherwise("first").alias("stages"),
    )
