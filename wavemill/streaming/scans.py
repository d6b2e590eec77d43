"""Streams of samples: source, blocks, envelope, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_SCHEMA = "recording_id string, channel string, sample_idx bigint, value double"
SCAN_SCHEMA = "recording_id string, scan_idx bigint, ch array<float>"


def read_files(
    spark: SparkSession,
    path: str,
    schema,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int = 256 << 20,
    name: str | None = None,
) -> DataFrame:
    """File stream.  The trigger bound also bounds what a stateful task sees of one key."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def event_time(started: Column, idx: Column, rate: float) -> Column:
    """Time of a sample of a recording that began at ``started``."""
    return F.timestamp_micros(F.unix_micros(started.cast("timestamp")) + (idx * F.lit(1e6 / rate)).cast("long"))


def windowed(
    samples: DataFrame, size: int, rate: float, started: Column | None, lateness: str, *keys
) -> DataFrame:
    """Group a sample stream by ``size``-sample blocks.

    ``started`` is when a row's recording began; with it, state is dropped once all streams are
    ``lateness`` past a block.  Without it recordings share no clock, so nothing may be called late:
    every block's state stays in the state store.
    """
    block = F.floor(F.col("sample_idx") / size).alias("block_id")
    if started is None:
        return samples.groupBy("recording_id", *keys, block)
    length = f"{round(size * 1e6 / rate)} microseconds"
    return (
        samples.withColumn("ts", event_time(started, F.col("sample_idx"), rate))
        .withWatermark("ts", lateness)
        .groupBy("recording_id", *keys, F.window("ts", length), block)
    )


def stream_blocks(
    samples: DataFrame,
    size: int,
    aggs: list[Column],
    rate: float = 250,
    started: Column | None = None,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Complete blocks of ``size`` samples (update mode: each leaves when it is full).

    With ``started``, recordings begin on the block grid of the clock.
    """
    return (
        windowed(samples, size, rate, started, lateness, "channel")
        .agg(*aggs, F.count(F.lit(1)).alias("scans"))
        .filter(F.col("scans") == size)
        .drop("window")
    )


def stream_envelope(
    samples: DataFrame,
    size: int,
    group: Column,
    margin: float = 0.05,
    rate: float = 250,
    started: Column | None = None,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Smallest and largest value per block and channel group, with the widened range."""
    span = F.max("value") - F.min("value")
    return (
        windowed(samples, size, rate, started, lateness, group.alias("channel_group"))
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            (F.min("value") - margin * span).alias("axis_low"),
            (F.max("value") + margin * span).alias("axis_high"),
        )
        .drop("window")
    )
