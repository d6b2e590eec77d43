"""Annotations, events and epochs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.operators.ordered import number_rows, previous_value, total_before


def encode_labels(annotations: DataFrame, rate: float = C.SAMPLING_RATE) -> DataFrame:
    """Onset as a sample index, and class ids counted from 1 in label order per recording.

    The rank runs over the distinct labels only; they come back by an equi join.
    """
    ids = (
        annotations.select("recording_id", "label")
        .distinct()
        .withColumn(
            "class_id",
            F.row_number().over(Window.partitionBy("recording_id").orderBy("label")),
        )
    )
    return annotations.join(ids, ["recording_id", "label"]).withColumn(
        "onset_idx", F.rint(F.col("onset_s") * rate).cast("long")
    )


def sub_event_offsets(
    rate: float,
    offset_s: int = C.EVENT_OFFSET_S,
    length_s: int = C.EVENT_LENGTH_S,
    trial_s: int = C.TRIAL_LENGTH_S,
) -> list[int]:
    """Sample offsets of the events inside one trial; empty if none fits."""
    return [round(s * rate) for s in range(offset_s, trial_s - length_s + 1, length_s)]


def sub_events(annotations: DataFrame, rate: float = C.SAMPLING_RATE, **trial) -> DataFrame:
    """Several events per annotated trial, at fixed offsets from its onset."""
    offsets = F.array(*[F.lit(o).cast("long") for o in sub_event_offsets(rate, **trial)])
    return annotations.select("*", F.posexplode(offsets).alias("sub_id", "_offset")).select(
        *[c for c in annotations.columns if c != "onset_idx"],
        "sub_id",
        (F.col("onset_idx") + F.col("_offset")).alias("onset_idx"),
    )


def epoch_extract(
    samples: DataFrame, events: DataFrame, first: int, last: int, keep_partial: bool = False
) -> DataFrame:
    """Samples at ``onset + first .. onset + last`` (both included) of each event.

    The small event side is expanded to sample indices, so the interval match
    becomes an equi join on (recording, sample index).  Epochs that run past
    the end of a channel are dropped; that count is over at most
    ``last - first + 1`` rows.
    """
    wanted = events.withColumn(
        "sample_idx", F.explode(F.sequence(F.col("onset_idx") + first, F.col("onset_idx") + last))
    )
    joined = wanted.join(samples, ["recording_id", "sample_idx"]).withColumn(
        "t", (F.col("sample_idx") - F.col("onset_idx") - first).cast("int")
    )
    if keep_partial:
        return joined
    w = Window.partitionBy("recording_id", "epoch_id", "channel")
    return (
        joined.withColumn("_n", F.count(F.lit(1)).over(w))
        .filter(F.col("_n") == last - first + 1)
        .drop("_n")
    )


def epoch_crop(epochs: DataFrame, first: int, last: int) -> DataFrame:
    """Keep ``first <= t <= last``."""
    return epochs.filter(F.col("t").between(first, last))


def any_movement(class_id: Column) -> Column:
    """First-stage label: both movement classes become 1."""
    return F.when(class_id == 2, F.lit(1)).otherwise(class_id)


def relabel_hierarchy(events: DataFrame) -> DataFrame:
    """Stage-1 label for every event, stage-2 label for movement events only."""
    return events.withColumn("stage1", any_movement(F.col("class_id"))).withColumn(
        "stage2", F.when(F.col("class_id") != 0, F.col("class_id"))
    )


def epoch_arrays(epochs: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """Dense value array per key, ordered by time."""
    points = F.sort_array(F.collect_list(F.struct(F.col(order), F.col("value"))))
    return (
        epochs.groupBy(*keys)
        .agg(points.alias("_p"))
        .select(*keys, F.transform("_p", lambda p: p["value"]).alias("values"))
    )


# Panes that are columns of one row.
PANES = 64


def window_starts(n_times: int, length: int, step: int) -> list[int]:
    """Starts of the running windows; the last possible start is excluded."""
    return list(range(0, n_times - length, step))


def sliding_sums(
    rows: DataFrame,
    keys: list[str],
    n_times: int,
    length: int,
    step: int,
    sums: dict[str, Column],
    order: str = "t",
) -> DataFrame:
    """Sums over running windows, through panes of gcd(length, step) rows.

    Each row is aggregated once into its pane; a window adds up its panes.  Up to ``PANES`` panes are columns of one row
    for each key, so that a task holds one table of its keys and windows need no table of their own.
    """
    pane = math.gcd(length, step)
    starts = window_starts(n_times, length, step)
    per = length // pane
    hop = step // pane
    if not starts or (len(starts) - 1) * hop + per > PANES:
        return grouped_sums(rows, keys, pane, per, hop, len(starts), sums, order)
    at = F.floor(F.col(order) / pane)
    columns = {**{n: F.sum for n in sums}, "n": F.count}
    taken = {**sums, "n": F.lit(1)}
    held = [
        [fn(F.when(at == p, taken[n])).alias(f"_{i}_{p}") for i, (n, fn) in enumerate(columns.items())]
        for p in range((len(starts) - 1) * hop + per)
    ]
    wide = rows.groupBy(*keys).agg(*[c for of_pane in held for c in of_pane])

    def total(i: int, w: int) -> Column:
        """The sum of a window's panes; those without a value count nothing."""
        parts = [F.col(f"_{i}_{p}") for p in range(w * hop, w * hop + per)]
        return reduce(lambda a, b: F.coalesce(a + b, a, b), parts)

    windows = [
        F.struct(F.lit(w).alias("window_id"), *[total(i, w).alias(n) for i, n in enumerate(columns)]) for w in range(len(starts))
    ]
    return wide.select(*keys, F.inline(F.array(*windows))).filter(F.col("n") > 0)


def grouped_sums(
    rows: DataFrame, keys: list[str], pane: int, per: int, hop: int, windows: int, sums: dict[str, Column], order: str
) -> DataFrame:
    """:func:`sliding_sums` with a row for each pane, for any number of them."""
    panes = rows.groupBy(*keys, F.floor(F.col(order) / pane).cast("int").alias("_pane")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("n")
    )
    # Windows that contain pane p start at hop * w with w*hop <= p < w*hop + per.
    low = F.greatest(F.lit(0), F.ceil((F.col("_pane") - per + 1) / hop)).cast("int")
    high = F.least(F.lit(windows - 1), F.floor(F.col("_pane") / hop)).cast("int")
    member = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return (
        panes.withColumn("window_id", F.explode(member))
        .groupBy(*keys, "window_id")
        .agg(*[F.sum(n).alias(n) for n in sums], F.sum("n").alias("n"))
    )


def window_center(window_id: Column, length: int, step: int, rate: int, tmin: float) -> Column:
    """Centre of a running window, in seconds."""
    return (window_id * step + length / 2.0) / rate + tmin


def change_only(
    commands: DataFrame, key: str = "key", value: str = "command", order: list[str] = ["ts", "event_id"]
) -> DataFrame:
    """Rows whose value differs from the row before of the same key."""
    placed = number_rows(commands, [key], order, "_idx")
    return (
        previous_value(placed, [key], "_idx", value, "_prev")
        .filter((F.col("_idx") == 0) | ~F.col("_prev").eqNullSafe(F.col(value)))
        .drop("_idx", "_prev")
    )


def label_intervals(
    blocks: DataFrame,
    key: str,
    label: str,
    order: list[str],
    blocks_per_second: int = C.BLOCKS_PER_SECOND,
    pause: str | None = None,
) -> DataFrame:
    """Runs of equal labels as (onset, duration, label); pauses make no interval.

    Runs are numbered by a running count of changes, so that a run is an
    ordinary group: a long one aggregates map-side.
    """
    placed = number_rows(blocks, [key], order, "_idx")
    flagged = previous_value(placed, [key], "_idx", label, "_prev").withColumn(
        "_change",
        (~F.col("_prev").eqNullSafe(F.col(label)) | (F.col("_idx") == 0)).cast("long"),
    )
    runs = (
        total_before(flagged, [key], "_idx", "_change", "_before")
        .withColumn("run", F.col("_before") + F.col("_change"))
        .groupBy(key, "run", label)
        .agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    )
    if pause is not None:
        runs = runs.filter(~F.col(label).eqNullSafe(F.lit(pause)))
    return runs.select(
        key,
        "run",
        label,
        (F.col("_first") / blocks_per_second).alias("onset_s"),
        (F.col("_n") / blocks_per_second).alias("duration_s"),
    )


def running_offset(blocks: DataFrame, keys: list[str], block: str, count: str) -> DataFrame:
    """Number of scans before each block."""
    placed = number_rows(blocks, keys, [block], "_idx")
    return total_before(placed, keys, "_idx", count, "offset").drop("_idx")


def tumbling_blocks(samples: DataFrame, size: int, aggs: list[Column]) -> DataFrame:
    """Complete blocks of ``size`` scans; an incomplete last block is dropped."""
    return (
        samples.groupBy(
            "recording_id",
            "channel",
            F.floor(F.col("sample_idx") / size).alias("block_id"),
        )
        .agg(*aggs, F.count(F.lit(1)).alias("scans"))
        .filter(F.col("scans") == size)
    )


def first_blocks(blocks: DataFrame, n: int = C.LIVE_BLOCK_LIMIT) -> DataFrame:
    return blocks.filter(F.col("block_id") < n)


def block_envelope(samples: DataFrame, size: int, group: Column, margin: float = 0.05) -> DataFrame:
    """Smallest and largest value per block and channel group, and the widened axis range."""
    low, high = F.min("value"), F.max("value")
    return (
        samples.groupBy(
            "recording_id",
            group.alias("channel_group"),
            F.floor(F.col("sample_idx") / size).alias("block_id"),
        )
        .agg(low.alias("low"), high.alias("high"))
        .withColumn("axis_low", F.col("low") - margin * (F.col("high") - F.col("low")))
        .withColumn("axis_high", F.col("high") + margin * (F.col("high") - F.col("low")))
    )


def envelope_pyramid(samples: DataFrame, size: int, group: Column, levels: int, margin: float = 0.05) -> DataFrame:
    """Envelopes of blocks of ``size``, 2 ``size``, 4 ``size`` ... samples, for views at several resolutions.

    Samples are read for the finest level only; each level is put together from the one below, two blocks
    at a time, so the work above the first level is a geometric series.
    """
    keys = ["recording_id", "channel_group"]
    finest = block_envelope(samples, size, group).select(*keys, "block_id", "low", "high")
    stack = [finest]
    for _ in range(1, levels):
        below = stack[-1].groupBy(*keys, F.floor(F.col("block_id") / 2).alias("block_id"))
        stack.append(below.agg(F.min("low").alias("low"), F.max("high").alias("high")))
    out = None
    for level, rows in enumerate(stack):
        named = rows.select(F.lit(level).alias("level"), "*")
        out = named if out is None else out.unionByName(named)
    span = margin * (F.col("high") - F.col("low"))
    return out.withColumn("axis_low", F.col("low") - span).withColumn("axis_high", F.col("high") + span)
