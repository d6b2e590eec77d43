"""Channel selection, validation, layout and device catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.operators.ordered import number_rows, top_rows, total_before


def select_channels(samples: DataFrame, channels: list[str] | None) -> DataFrame:
    """Keep the listed channels.  ``None`` or an empty list keeps all of them."""
    if not channels:
        return samples
    return samples.filter(F.col("channel").isin(list(channels)))


def channels_not_found(wanted: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Distinct requested names that are absent: an anti join."""
    return wanted.select(column).distinct().join(present.select(column), column, "left_anti")


def channel_power(filtered: DataFrame) -> DataFrame:
    """Mean absolute value per channel of an already band-passed recording."""
    return filtered.groupBy("recording_id", "channel").agg(F.avg(F.abs("value")).alias("power"))


def channel_validation(
    power: DataFrame, selected: list[str], threshold: float = C.VALID_CHANNEL_THRESHOLD
) -> DataFrame:
    """Four-way report: selected or additional, valid or invalid."""
    return power.select(
        "recording_id",
        "channel",
        F.when(F.col("channel").isin(list(selected)), "selected")
        .otherwise("additional")
        .alias("role"),
        F.when(F.col("power") > threshold, "valid").otherwise("invalid").alias("state"),
    )


def missing_selected(power: DataFrame, selected: list[str]) -> DataFrame:
    """Selected channels a recording does not have, as report rows ('not found')."""
    asked = F.explode(F.array(*[F.lit(c) for c in selected])).alias("channel")
    return (
        power.select("recording_id")
        .distinct()
        .select("recording_id", asked)
        .join(power.select("recording_id", "channel"), ["recording_id", "channel"], "left_anti")
        .select("recording_id", "channel", F.lit("selected").alias("role"), F.lit("not found").alias("state"))
    )


def channel_mask(catalog: DataFrame, available: Column, requested: Column) -> DataFrame:
    return catalog.withColumn("acquire", available & requested)


def scan_to_long(scans: DataFrame, names: list[str], keys: list[str], limit: int = 32) -> DataFrame:
    """One row per electrode of each scan; columns after the first ``limit`` are not electrodes."""
    lookup = F.array(*[F.lit(n) for n in names])
    return scans.select(
        *keys, F.posexplode(F.slice("ch", 1, limit)).alias("_pos", "value")
    ).select(
        *keys,
        F.get(lookup, F.col("_pos")).alias("channel"),
        F.col("value").cast("double").alias("value"),
    )


def common_average_reference(samples: DataFrame) -> DataFrame:
    """Subtract the across-channel mean of each sample; a window holds one scan's channels."""
    scan = Window.partitionBy("recording_id", "sample_idx")
    return samples.withColumn("value", F.col("value") - F.avg("value").over(scan))


def scan_layout(catalog: DataFrame) -> DataFrame:
    """Column index after each layout entry: running sum of the enabled widths per device."""
    used = catalog.withColumn(
        "used", F.when(F.col("enabled"), F.col("width")).otherwise(F.lit(0)).cast("long")
    )
    placed = number_rows(used, ["device"], ["position"], "_idx")
    return total_before(placed, ["device"], "_idx", "used", "first_column").select(
        "device",
        "position",
        "first_column",
        (F.col("first_column") + F.col("used")).alias("index_after"),
    )


def nth_lowest_rate(catalog: DataFrame, n: int = 2) -> DataFrame:
    """n-th lowest distinct rate per device.

    Rates are first reduced to distinct pairs, so a device group holds its rates only.
    """
    distinct = catalog.select("device", "rate").distinct()
    return (
        top_rows(distinct, ["device"], [F.asc("rate")], n)
        .groupBy("device")
        .agg(F.max("rate").alias("rate"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == n)
        .drop("_n")
    )


def filter_catalog_match(devices: DataFrame, filters: DataFrame) -> DataFrame:
    """First filter of the device at its sampling rate; NULL if there is none."""
    first = filters.groupBy("device", "rate").agg(F.min("filter_index").alias("filter_index"))
    return devices.join(first, ["device", "rate"], "left")
