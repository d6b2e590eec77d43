"""Running classifier: models trained on whole epochs, rated on sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.operators import blocks as bk
from wavemill.operators import evaluate, linear, spatial, splits
from wavemill.operators.events import window_center

CELL = ["recording_id", "band_id"]
SPLIT = [*CELL, "split_id"]


def running_scores(
    epochs: DataFrame,
    bands: list[tuple[int, float, float]],
    n_splits: int = splits.N_SPLITS,
    rate: int = C.SAMPLING_RATE,
    tmin: float = 1.0,
    length: int | None = None,
    step: int | None = None,
    **filtering,
) -> DataFrame:
    """Accuracy per (recording, band, split, window); one-second windows every tenth of a second.

    Each band keeps its own filters.
    """
    length, step = length or rate, step or int(rate * 0.1)
    filtered = bk.band_epochs(epochs, bands, "samples", rate=rate, **filtering)
    filtered = filtered.drop("n_times").persist()
    roles = splits.shuffle_split(epochs, n_splits)
    grams = spatial.epoch_gram(filtered).persist()
    filters = spatial.csp_filters(
        spatial.class_covariance(grams, roles, n_splits, CELL), SPLIT
    ).persist()
    by_epoch = ["recording_id", "epoch_id", "split_id"]

    def features(source, role):
        chosen = roles.filter(F.col("role") == role).drop("role")
        return spatial.csp_log_power(source, filters, CELL).join(chosen, by_epoch)

    models = linear.lda_fit(linear.lda_statistics(features(grams, "train"), SPLIT), SPLIT)
    windows = spatial.window_gram(filtered, length, step)
    scored = linear.linear_score(features(windows, "test"), models, SPLIT)
    return evaluate.accuracy_per_split(
        scored.withColumnRenamed("class_id", "actual"), [*SPLIT, "window_id"]
    ).withColumn("center_s", window_center(F.col("window_id"), length, step, rate, tmin))
