"""Whole jobs: folders of recordings to result tables, and result tables to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.operators import events, report
from wavemill.operators.ordered import number_rows
from wavemill.plans import sweep
from wavemill.session import materialize
from wavemill.sources import edf, tabular

# <participant folder>/<19-character date>_<task>.edf
NAME = r"([^/]+)/([^/]{19})_([^/]*)\.edf$"


def recording_keys(recordings: DataFrame) -> DataFrame:
    """Participant, date and task out of the recording path."""
    path = F.col("recording_id")
    return recordings.select(
        "recording_id",
        *[
            F.regexp_extract(path, NAME, i).alias(c)
            for i, c in ((1, "participant"), (2, "date"), (3, "task"))
        ],
    )


def ingest(spark: SparkSession, folders: list[str], lake: str) -> None:
    """Decode the recordings of every participant folder once, into Parquet."""
    for folder in folders:
        edf.ingest(spark, folder, lake)


def recording_rates(chunks: DataFrame, selected: list[str]) -> DataFrame:
    """(recording_id, rate): the rate of most of a recording's selected channels, the higher one of two."""
    wanted = F.col("channel").isin(selected) if selected else F.lit(True)
    channels = chunks.select("recording_id", "channel", "rate").distinct()
    counted = channels.groupBy("recording_id", "rate").agg(F.sum(wanted.cast("int")).alias("n"))
    return counted.groupBy("recording_id").agg(F.max_by("rate", F.struct("n", "rate")).alias("rate"))


def sweep_lake(spark: SparkSession, lake: str, selected: list[str] = C.SWEEP_CHANNELS, **options) -> DataFrame:
    """Result rows of all recordings in a lake; recordings of one rate share a sweep.

    A recording whose channels differ in rate is swept once, with the channels of its usual rate.
    """
    decoded = spark.read.parquet(lake)
    chunks = edf.sample_chunks(decoded)
    rates = materialize(recording_rates(chunks, selected))
    notes = number_rows(
        edf.annotation_rows(decoded), ["recording_id"], ["onset_s", "label"], "annotation_id"
    )
    out = None
    # The list of sampling rates is short: devices offer a handful.
    for (rate,) in rates.select("rate").distinct().orderBy("rate").toLocalIterator():
        members = rates.filter(F.col("rate") == rate).select("recording_id")
        rows = sweep.sweep(
            chunks.filter(F.col("rate") == rate).join(members, "recording_id", "left_semi"),
            events.encode_labels(notes.join(members, "recording_id", "left_semi"), rate),
            selected,
            rate=rate,
            **options,
        )
        out = rows if out is None else out.unionByName(rows)
    return out.join(recording_keys(out.select("recording_id").distinct()), "recording_id")


def bulk(spark: SparkSession, folders: list[str], lake: str, results: str, **options) -> None:
    """Recordings -> lake -> result table, partitioned by participant; a second run replaces the rows of its participants."""
    ingest(spark, folders, lake)
    rows = sweep_lake(spark, lake, **options)
    tabular.write_results(report.with_keys_first(rows, ["participant", "task", "date", "classifier"]), results)


def write_reports(spark: SparkSession, results: str, out: str, excluded_date: str) -> None:
    """The four reports as CSV with a running index; failed cells take no part."""
    rows = spark.read.schema(tabular.STORED_SCHEMA).parquet(results).filter(F.col("error").isNull())
    keys = {
        "best": ["participant", "task", "classifier"],
        "difference": ["participant", "task"],
        "by_task": ["task", "classifier"],
        "by_family": ["participant", "type"],
    }
    for name, df in report.reports(rows, excluded_date).items():
        tabular.write_csv(df, f"{out}/{name}", keys[name])

