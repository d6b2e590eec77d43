"""Reports on the sweep result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.scalars import round_half_even, task_family
from wavemill.operators.ordered import top_rows

KEYS = [
    "participant",
    "task",
    "date",
    "classifier",
    "frequency",
    "configuration",
    "frequency_start",
    "frequency_end",
]
GROUP = ["participant", "task", "classifier"]
TOP = 20


def drop_matching_keep_null(df: DataFrame, column: str, text: str) -> DataFrame:
    """Drop rows whose column contains the text; a NULL does not contain it."""
    return df.filter(~F.coalesce(F.col(column).contains(text), F.lit(False)))


def number_or_null(column: str):
    """NaN counts as missing."""
    return F.when(~F.isnan(column), F.col(column))


def with_keys_first(df: DataFrame, keys: list[str], **constants) -> DataFrame:
    """Append constant columns and move the key columns to the front."""
    out = df.withColumns({k: F.lit(v) for k, v in constants.items()})
    return out.select(*keys, *[c for c in out.columns if c not in keys])


def mean_over_splits(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean accuracy per grid cell; rows with a NULL key are left out."""
    return (
        results.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.avg(number_or_null("accuracy")).alias("accuracy"))
    )


def topk_mean(cells: DataFrame, keys: list[str] = GROUP, k: int = TOP) -> DataFrame:
    """Mean of the k best cells per group; NaN and NULL do not take part.

    Which of several equal accuracies is kept makes no difference to the mean.
    """
    usable = cells.select(*keys, number_or_null("accuracy").alias("accuracy")).dropna(
        subset=["accuracy"]
    )
    return (
        top_rows(usable, keys, [F.desc("accuracy")], k)
        .groupBy(*keys)
        .agg(round_half_even(F.avg("accuracy")).alias("accuracy"))
    )


def method_difference(
    best: DataFrame, base: str = "csp", order: str = "classifier", strict: bool = False
) -> DataFrame:
    """Accuracy of the base method minus the first other method per (participant, task).

    The base rows drive.  Without a partner the difference is NULL, or an error
    if ``strict``.
    """
    pair = ["participant", "task"]
    other = (
        best.filter(F.col("classifier") != base)
        .groupBy(*pair)
        .agg(F.min_by("accuracy", order).alias("other"))
    )
    diff = round_half_even(F.col("accuracy") - F.col("other"))
    if strict:
        diff = F.when(
            F.col("other").isNull(), F.raise_error(F.lit("no other method to compare with"))
        ).otherwise(diff)
    return (
        best.filter(F.col("classifier") == base)
        .join(other, pair, "left")
        .select(*pair, diff.cast("double").alias("diff"))
    )


# Doubles of three decimals up to 1 are whole multiples of 2^-62.
UNIT = float(2**62)


def mean_of_rounded() -> Column:
    """Rounded mean of accuracies that have three decimals.

    Such means often end in a tie, which the last bit of the sum decides.  The doubles are
    therefore added exactly, as integers, and the row order does not matter.
    """
    whole = (F.col("accuracy") * F.lit(UNIT)).cast("long").cast("decimal(20,0)")
    total = F.sum(whole).cast("double") / F.lit(UNIT)
    return round_half_even(total / F.count("accuracy")).alias("accuracy")


def mean_over_participants(best: DataFrame) -> DataFrame:
    return best.groupBy("task", "classifier").agg(mean_of_rounded())


def mean_by_family(best: DataFrame) -> DataFrame:
    return best.groupBy("participant", task_family(F.col("task")).alias("type")).agg(
        mean_of_rounded()
    )


def accuracy_curve(results: DataFrame) -> DataFrame:
    """Mean accuracy by band centre and configuration, with a one-deviation band."""
    acc = number_or_null("accuracy")
    mean, sd = F.avg(acc), F.stddev_samp(acc)
    return results.groupBy("configuration", "frequency").agg(
        mean.alias("mean"),
        sd.alias("sd"),
        (mean - sd).alias("low"),
        (mean + sd).alias("high"),
    )


def union_results(parts: list[DataFrame]) -> DataFrame:
    """Append stored result pieces by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reports(results: DataFrame, excluded_date: str) -> dict[str, DataFrame]:
    """The four reports; the first feeds the other three and is cached."""
    cells = mean_over_splits(drop_matching_keep_null(results, "date", excluded_date))
    best = topk_mean(cells).cache()
    return {
        "best": best.orderBy(*GROUP),
        "difference": method_difference(best).orderBy("participant", "task"),
        "by_task": mean_over_participants(best).orderBy("task", "classifier"),
        "by_family": mean_by_family(best).orderBy("participant", "type"),
    }
