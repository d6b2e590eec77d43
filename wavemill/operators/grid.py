"""Key tables of a sweep.  The grid is a list of constants, so it is exploded from a
literal: no join, and one Spark job covers every cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions.scalars import configuration_label


def bands(
    start: int = C.SWEEP_START_HZ, stop: int = C.SWEEP_STOP_HZ, widths: list[int] = C.SWEEP_WIDTHS
) -> list[tuple[int, float, float]]:
    """(band_id, low, high) of every grid cell."""
    cells = [(f, w) for f in range(start, stop) for w in widths]
    return [(i, float(f), float(f + w)) for i, (f, w) in enumerate(cells)]


def literals(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def sweep_grid(
    recordings: DataFrame,
    channels: list[str] = C.SWEEP_CHANNELS,
    widths: list[int] = C.SWEEP_WIDTHS,
    start: int = C.SWEEP_START_HZ,
    stop: int = C.SWEEP_STOP_HZ,
) -> DataFrame:
    """Every recording with every start frequency and width, and the names of the cell."""
    low, width = F.col("frequency_start"), F.col("band_width")
    names = literals(channels) if channels else F.array().cast("array<string>")
    return (
        recordings.withColumn("frequency_start", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        .withColumn("band_width", F.explode(literals(widths)))
        .select(
            *recordings.columns,
            configuration_label(width, names).alias("configuration"),
            ((low * 2 + width) / 2.0).alias("frequency"),
            "frequency_start",
            (low + width).alias("frequency_end"),
        )
    )


def with_methods(recordings: DataFrame, methods: list[str]) -> DataFrame:
    """Recording x feature method."""
    return recordings.withColumn("classifier", F.explode(literals(methods)))


def trial_schedule(
    sessions: DataFrame,
    labels: list[str] = C.TRIAL_LABELS,
    trials: int = C.TRIAL_COUNT,
    seed: int = 42,
) -> DataFrame:
    """Every label ``trials`` times per session, in a seeded random order.

    The order key is a text hash; a session has ``trials * len(labels)`` rows.
    """
    rows = sessions.select(
        "session_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    ).withColumn("label", F.explode(literals(labels)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "session_id", "trial", "label"))
    w = Window.partitionBy("session_id").orderBy(key)
    return rows.withColumn("position", F.row_number().over(w))
