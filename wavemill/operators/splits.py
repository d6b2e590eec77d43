"""Repeated random train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.ordered import join_on

SEED = 42
STAGED_SEED = 23
N_SPLITS = 10
TEST_SHARE = 0.2
# Expected epochs per hash bucket.
BUCKET = 100_000


def shuffle_split(
    epochs: DataFrame,
    n_splits: int = N_SPLITS,
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    bucket: int = BUCKET,
) -> DataFrame:
    """(recording_id, split_id, epoch_id, role); ceil(share * n) epochs of a recording test.

    Epochs are ranked by a text hash of (seed, split, epoch).  The hash is spread
    evenly, so equal hash ranges hold about ``bucket`` epochs each: the rank is the
    position inside the range plus the counts of the ranges before it.
    """
    ids = epochs.select("recording_id", "epoch_id")
    sizes = ids.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "split_id", "epoch_id"))
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    keyed = (
        ids.join(sizes, "recording_id")
        .withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumn("_h", order)
        .withColumn("_range", F.floor(share * F.ceil(F.col("_n") / bucket)))
    )
    group = ["recording_id", "split_id"]
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        keyed.groupBy(*group, "_range")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*group, "_range", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, "_range").orderBy("_h", "epoch_id")
    rank = F.col("_before") + F.row_number().over(inside)
    return join_on(keyed, before, [*group, "_range"]).select(
        *group,
        "epoch_id",
        F.when(rank <= F.ceil(F.lit(test_share) * F.col("_n")), "test")
        .otherwise("train")
        .alias("role"),
    )

