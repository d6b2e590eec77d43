"""Two-stage classifier: idle against any movement, then left against right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators import blocks as bk
from wavemill.operators import evaluate, linear, spatial, splits
from wavemill.operators.events import relabel_hierarchy

N_COMPONENTS = 10
BASE = ["recording_id", "band_id"]
STAGE = ["recording_id", "band_id", "stage"]
MODEL = [*STAGE, "split_id"]


def two_stage_predictions(
    epochs: DataFrame,
    bands: list[tuple[int, float, float]],
    n_splits: int = splits.N_SPLITS,
    transition: float = 0.5,
    window: tuple[int, int] | None = None,
    **filtering,
) -> DataFrame:
    """Test predictions per (recording, band, split, epoch), classes 0, 1 and 2.

    With ``window`` (length, step), models rate each running window of the test epochs.

    Stage is a key column: both stages share filters, covariances and solves.  The
    second stage trains on movement epochs only, yet rates every test epoch; its
    answer counts where the first stage says movement.
    """
    roles = splits.shuffle_split(epochs, n_splits, seed=splits.STAGED_SEED)
    filtered = bk.band_epochs(epochs, bands, "samples", transition=transition, **filtering)
    filtered = filtered.drop("n_times").persist()
    grams = spatial.epoch_gram(filtered).persist()

    def staged(rows: DataFrame) -> DataFrame:
        return (
            relabel_hierarchy(rows)
            .withColumn("stage", F.explode(F.array(F.lit(1), F.lit(2))))
            .withColumn(
                "class_id", F.when(F.col("stage") == 1, F.col("stage1")).otherwise(F.col("stage2"))
            )
            .drop("stage1", "stage2")
        )

    trained = staged(grams).filter(F.col("class_id").isNotNull())
    covariance = spatial.class_covariance(trained, roles, n_splits, STAGE)
    filters = spatial.csp_filters(covariance, MODEL, N_COMPONENTS).persist()

    def features(rows: DataFrame, role: str) -> DataFrame:
        chosen = roles.filter(F.col("role") == role).drop("role")
        return spatial.csp_log_power(staged(rows), filters, STAGE).join(
            chosen, ["recording_id", "split_id", "epoch_id"]
        )

    train = features(grams, "train").filter(F.col("class_id").isNotNull())
    models = linear.lda_fit(linear.lda_statistics(train, MODEL), MODEL)
    rated = grams if window is None else spatial.window_gram(filtered, *window)
    scored = linear.linear_score(features(rated, "test"), models, MODEL)
    key = [*BASE, "split_id", "epoch_id", *([] if window is None else ["window_id"])]
    first = scored.filter("stage = 1").select(*key, "predicted")
    second = scored.filter("stage = 2").select(*key, "predicted")
    actual = epochs.select("recording_id", "epoch_id", F.col("class_id").alias("actual"))
    return evaluate.two_stage_decision(first, second, key).join(actual, ["recording_id", "epoch_id"])


def two_stage_scores(epochs: DataFrame, bands, window=None, **options) -> DataFrame:
    by = [*BASE, "split_id", *([] if window is None else ["window_id"])]
    return evaluate.accuracy_per_split(
        two_stage_predictions(epochs, bands, window=window, **options), by
    )
