"""Signal-shaped views on the test tables, each with the same view in SQL.

The ``*_SQL`` strings are CTE bodies for the oracle statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.scalars import recording_stamp
from wavemill.operators.ordered import number_rows
from wavemill.sources.tables import table

# Sampling rate assumed for epochs cut out of the samples view.
VIEW_RATE = 4
# Shape of one epoch in the tensor view.
TENSOR_CHANNELS = 8
TENSOR_TIMES = 8

# Event type -> task name.
TASKS = {
    "click": "imagery_click",
    "signup": "imagery_signup",
    "purchase": "real_purchase",
    "view": "real_view",
    "error": "observed_error",
}


def props_k():
    return F.get_json_object("props", "$.k").cast("int")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep-result rows: keys, a band cell and an accuracy; some dates and accuracies missing."""
    task = F.create_map(*[F.lit(v) for kv in TASKS.items() for v in kv])
    start = F.lit(2) + F.col("k") % 4
    width = F.lit(1) + F.floor(F.col("event_id") / 2).cast("int") % 2
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", props_k())
        .select(
            F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("participant"),
            task[F.col("event_type")].alias("task"),
            F.when(F.col("k") % 50 != 7, recording_stamp(F.date_trunc("week", "ts"))).alias("date"),
            F.when(F.col("event_id") % 2 == 0, "csp").otherwise("parafac").alias("classifier"),
            F.when(F.col("k") == 13, F.lit(float("nan")))
            .otherwise(F.col("value") / (F.col("value") + 50.0))
            .alias("accuracy"),
            (start + width / 2.0).alias("frequency"),
            F.concat(width.cast("string"), F.lit("Hz width 11 channels")).alias("configuration"),
            start.alias("frequency_start"),
            (start + width).alias("frequency_end"),
        )
    )


RESULTS_SQL = """raw_results AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
         CAST(1 + (event_id // 2) % 2 AS INTEGER) AS width
  FROM events),
results AS (
  SELECT 'p' || (user_id % 10) AS participant,
         CASE event_type WHEN 'click' THEN 'imagery_click' WHEN 'signup' THEN 'imagery_signup'
              WHEN 'purchase' THEN 'real_purchase' WHEN 'view' THEN 'real_view'
              WHEN 'error' THEN 'observed_error' END AS task,
         CASE WHEN k % 50 <> 7 THEN strftime(date_trunc('week', ts), '%Y-%m-%dT%H-%M-%S') END AS date,
         CASE WHEN event_id % 2 = 0 THEN 'csp' ELSE 'parafac' END AS classifier,
         CASE WHEN k = 13 THEN CAST('NaN' AS DOUBLE) ELSE value / (value + 50.0) END AS accuracy,
         2 + k % 4 + width / 2.0 AS frequency,
         width || 'Hz width 11 channels' AS configuration,
         CAST(2 + k % 4 AS INTEGER) AS frequency_start,
         CAST(2 + k % 4 + width AS INTEGER) AS frequency_end
  FROM raw_results)"""


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples before numbering: ten recordings, one channel per event type."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("rec"), (F.col("user_id") % 10).cast("string")).alias("recording_id"),
        F.col("event_type").alias("channel"),
        "ts",
        "event_id",
        "value",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(
        sample_rows(spark, sf_dir), ["recording_id", "channel"], ["ts", "event_id"], "sample_idx"
    ).select("recording_id", "channel", "sample_idx", "value")


SAMPLES_SQL = """samples AS (
  SELECT 'rec' || (user_id % 10) AS recording_id, event_type AS channel,
         row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id) - 1
           AS sample_idx, value, event_id
  FROM events)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated trials of the samples view: one per 'error' sample."""
    numbered = number_rows(
        sample_rows(spark, sf_dir).filter(F.col("channel") == "error"),
        ["recording_id"],
        ["ts", "event_id"],
        "onset_idx",
    )
    return numbered.select(
        "recording_id",
        F.col("event_id").alias("annotation_id"),
        "onset_idx",
        F.when(F.col("event_id") % 2 == 0, "movement").otherwise("rest").alias("label"),
    )


ANNOTATIONS_SQL = """annotations AS (
  SELECT 'rec' || (user_id % 10) AS recording_id, event_id AS annotation_id,
         row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS onset_idx,
         CASE WHEN event_id % 2 = 0 THEN 'movement' ELSE 'rest' END AS label
  FROM events WHERE event_type = 'error')"""


def epochs(spark: SparkSession, sf_dir: str, channels: int = TENSOR_CHANNELS) -> DataFrame:
    """One row per epoch: ``data`` is channel-major, ``channels`` x ``n_times``.

    All labels are under ten, so every epoch falls into one recording: the hottest key.
    """
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("rec"), F.floor(F.col("label") / 10).cast("string")).alias("recording_id"),
        F.col("vec_id").alias("epoch_id"),
        (F.col("label") % 2).cast("int").alias("class_id"),
        F.col("embedding").cast("array<double>").alias("data"),
        F.lit(channels).alias("n_channels"),
    )


def epoch_samples(spark: SparkSession, sf_dir: str, times: int = TENSOR_TIMES) -> DataFrame:
    """Long form of the tensor view."""
    return epochs(spark, sf_dir).select(
        "recording_id", "epoch_id", "class_id", F.posexplode("data").alias("pos", "value")
    ).select(
        "recording_id",
        "epoch_id",
        "class_id",
        F.floor(F.col("pos") / times).cast("int").alias("channel"),
        (F.col("pos") % times).cast("int").alias("t"),
        "value",
    )


def epochs_sql(times: int = TENSOR_TIMES) -> str:
    return f"""tensor AS (
  SELECT 'rec0' AS recording_id, vec_id AS epoch_id, CAST(label % 2 AS INTEGER) AS class_id,
         CAST((pos - 1) // {times} AS INTEGER) AS channel,
         CAST((pos - 1) % {times} AS INTEGER) AS t,
         CAST(embedding[pos] AS DOUBLE) AS value
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("epoch_id"),
        (F.col("doc_id") % 10).cast("int").alias("split_id"),
        F.col("toxic").alias("predicted"),
        F.col("quality").alias("actual"),
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT doc_id AS epoch_id, CAST(doc_id % 10 AS INTEGER) AS split_id,
         toxic AS predicted, quality AS actual
  FROM labels)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command stream: one key per user, playing time in seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").alias("command"),
        (F.col("value") * 600.0).alias("playing_s"),
    )


COMMANDS_SQL = """commands AS (
  SELECT user_id AS key, ts, event_id, event_type AS command, value * 600.0 AS playing_s FROM events)"""


def layout_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("device"),
        F.col("p_partkey").alias("position"),
        F.col("p_size").alias("width"),
        (~F.col("p_type").eqNullSafe(F.lit("ECONOMY"))).alias("enabled"),
    )


LAYOUT_SQL = """layout AS (
  SELECT p_brand AS device, p_partkey AS position, p_size AS width,
         p_type IS DISTINCT FROM 'ECONOMY' AS enabled FROM part)"""
