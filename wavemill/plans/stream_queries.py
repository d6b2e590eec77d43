"""Registered queries: streams run to the end of the data, block scoring, file ingest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions import taps
from wavemill.plans.signal_queries import BLOCK, taps_sql
from wavemill.plans.sqltext import half_even, with_ctes
from wavemill.registry import SQL, query
from wavemill.sources import edf, views
from wavemill.sources.tables import table
from wavemill.streaming import commands, live, scans, sinks

# --- samples ---------------------------------------------------------------


def sample_stream(spark, sf):
    """The samples view as a file stream."""
    folder = sinks.new_folder(spark, "samples")
    views.samples(spark, sf).write.parquet(folder)
    return scans.read_files(spark, folder, scans.SAMPLE_SCHEMA, files_per_trigger=2)


def stream_append(spark, sf):
    out = sinks.new_folder(spark, "append")
    sinks.append_parquet(sample_stream(spark, sf), out, ["recording_id"])
    return sinks.result(spark, out, scans.SAMPLE_SCHEMA)


query(
    "stream_append",
    with_ctes(views.SAMPLES_SQL) + "SELECT recording_id, channel, sample_idx, value FROM samples",
)(stream_append)


def stream_blocks(spark, sf):
    out = sinks.new_folder(spark, "blocks")
    stream = scans.stream_blocks(
        sample_stream(spark, sf),
        BLOCK,
        [F.max("value").alias("peak")],
    )
    sinks.each_batch(stream, out)
    schema = "recording_id string, channel string, block_id bigint, peak double, scans bigint"
    return sinks.result(spark, out, schema)


query(
    "stream_blocks",
    with_ctes(views.SAMPLES_SQL)
    + f"""SELECT recording_id, channel, sample_idx // {BLOCK} AS block_id, max(value) AS peak,
  count(*) AS scans FROM samples GROUP BY ALL HAVING count(*) = {BLOCK}""",
)(stream_blocks)


def stream_envelope(spark, sf):
    out = sinks.new_folder(spark, "envelope")
    stream = scans.stream_envelope(
        sample_stream(spark, sf),
        BLOCK,
        F.when(F.col("channel") == "error", 1).otherwise(0),
    )
    sinks.each_batch(stream, out)
    values = ["low", "high", "axis_low", "axis_high"]
    latest = F.max_by(F.struct(*values), F.col("batch")).alias("latest")
    df = spark.read.parquet(f"{out}/data").groupBy("recording_id", "channel_group", "block_id").agg(latest)
    return df.select(
        "recording_id",
        "channel_group",
        "block_id",
        "latest.low",
        "latest.high",
        F.round("latest.axis_low", 6).alias("axis_low"),
        F.round("latest.axis_high", 6).alias("axis_high"),
    )


query("stream_envelope", SQL["block_envelope"])(stream_envelope)



#: Files of one slice of a stream, written by as many tasks.
FILES = 4


def stream_until_limit(spark, sf):
    """Blocks of a stream that its consumer ends as soon as the last wanted block has passed."""
    folder = sinks.new_folder(spark, "ordered")
    slot = F.floor(F.col("sample_idx") / (BLOCK * C.LIVE_BLOCK_LIMIT))
    # Files of the first blocks first.
    rows = views.samples(spark, sf).withColumn("slot", slot)
    for part in (rows.filter("slot = 0"), rows.filter("slot > 0")):
        part.drop("slot").repartition(FILES).write.mode("append").parquet(folder)
    stream = scans.read_files(spark, folder, scans.SAMPLE_SCHEMA, files_per_trigger=1)
    stream = stream.observe("seen", F.max(F.floor(F.col("sample_idx") / BLOCK)).alias("block"))
    wanted = F.col("sample_idx") < BLOCK * C.LIVE_BLOCK_LIMIT
    blocks = scans.stream_blocks(stream.filter(wanted), BLOCK, [F.max("value").alias("peak")])
    out = sinks.new_folder(spark, "until")

    def enough(progress):
        seen = progress.observedMetrics.get("seen")
        return seen is not None and seen["block"] is not None and seen["block"] >= C.LIVE_BLOCK_LIMIT

    sinks.run_until(blocks, out, enough, mode="update", until_idle=True)
    schema = "recording_id string, channel string, block_id bigint, peak double, scans bigint"
    return sinks.result(spark, out, schema)


query("stream_until_limit", SQL["first_n_blocks"])(stream_until_limit)

# --- commands --------------------------------------------------------------


SLICES = 3


def command_files(spark, sf):
    """The events in time order, a slice of files for each micro-batch."""
    folder = sinks.new_folder(spark, "events")
    events_ = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events_.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // SLICES + 1
    for k in range(SLICES):  # one write after the other, so that the files are in order
        part = events_.filter(F.floor((at - F.lit(low)) / step) == k)
        part.repartition(FILES).write.mode("append").parquet(folder)
    return scans.read_files(spark, folder, events_.schema, files_per_trigger=FILES)


def command_stream(spark, sf, name, rule):
    raw = command_files(spark, sf).select(
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("event_type").alias("command"),
        (F.col("value") * 600.0).alias("playing_s"),
    )
    out = sinks.new_folder(spark, name)
    sinks.append_parquet(rule(raw), out)
    return sinks.result(spark, out, commands.OUTPUT)


query("stream_change_only", SQL["change_only"])(
    lambda spark, sf: command_stream(spark, sf, "changes", commands.stream_change_only).select(
        "key", "event_id", "command"
    )
)
query("stream_throttle", SQL["throttle_commands"])(
    lambda spark, sf: command_stream(spark, sf, "throttle", commands.stream_throttle).select(
        "key", "event_id"
    )
)

# --- block scoring ---------------------------------------------------------

SCAN_BLOCK = 50
WIDTH = 32


def scan_rows(spark, sf):
    """Embeddings as scans: the first 32 columns are electrodes."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("rec"), F.floor(F.col("vec_id") / 250).cast("string")).alias("recording_id"),
        (F.col("vec_id") % 250).alias("scan_idx"),
        F.slice("embedding", 1, WIDTH).alias("ch"),
    )


def fixed_block_model():
    """Mean and alternating sum of the electrodes; class 1 where the second has more power."""
    root = 1 / math.sqrt(WIDTH)
    filters = np.array([[root] * WIDTH, [root if c % 2 == 0 else -root for c in range(WIDTH)]])
    return live.BlockModel(
        taps.bandpass(*C.LIVE_BAND, C.SAMPLING_RATE),
        filters,
        np.array([0, 1]),
        np.eye(2),
        np.array([0.0, 0.125]),
        tuple(range(WIDTH)),
    )


SCORE_SQL = with_ctes(
    f"""x AS (
  SELECT 'rec' || (vec_id // 250) AS recording_id, (vec_id % 250) // {SCAN_BLOCK} AS block_id,
         (vec_id % 250) % {SCAN_BLOCK} AS p, CAST(c AS INTEGER) AS c,
         CAST(embedding[c] AS DOUBLE) AS v, count(*) OVER (
           PARTITION BY vec_id // 250, (vec_id % 250) // {SCAN_BLOCK}, c) AS n
  FROM embeddings, range(1, {WIDTH + 1}) r(c) QUALIFY n = {SCAN_BLOCK})""",
    f"""s AS (
  SELECT recording_id, block_id, p, sum(v) / sqrt({WIDTH}) AS f0,
         sum(CASE WHEN c % 2 = 1 THEN v ELSE -v END) / sqrt({WIDTH}) AS f1 FROM x GROUP BY ALL)""",
    f"""ends AS (
  SELECT recording_id, block_id, arg_min(f0, p) AS a0, arg_min(f1, p) AS a1, arg_max(f0, p) AS z0,
         arg_max(f1, p) AS z1 FROM s GROUP BY ALL)""",
    f"""e AS (
  SELECT recording_id, block_id, p, f0, f1 FROM s
  UNION ALL SELECT recording_id, block_id, -p, 2 * a0 - f0, 2 * a1 - f1
    FROM s JOIN ends USING (recording_id, block_id) WHERE p > 0
  UNION ALL SELECT recording_id, block_id, 2 * {SCAN_BLOCK - 1} - p, 2 * z0 - f0, 2 * z1 - f1
    FROM s JOIN ends USING (recording_id, block_id) WHERE p < {SCAN_BLOCK - 1})""",
    f"taps AS ({taps_sql(14, 20, 2, 2, C.SAMPLING_RATE)})",
    """y AS (
  SELECT s.recording_id, s.block_id, s.p, sum(h * e.f0) AS y0, sum(h * e.f1) AS y1
  FROM s JOIN e ON e.recording_id = s.recording_id AND e.block_id = s.block_id
  JOIN taps ON k = s.p - e.p GROUP BY ALL)""",
)
SCORE_SQL += """SELECT recording_id, block_id,
  CAST(CASE WHEN ln(avg(y1 * y1)) + 0.125 > ln(avg(y0 * y0)) THEN 1 ELSE 0 END AS INTEGER) AS label
FROM y GROUP BY recording_id, block_id"""

query("block_score", SCORE_SQL)(
    lambda spark, sf: live.score_blocks(scan_rows(spark, sf), fixed_block_model(), SCAN_BLOCK)
)


def stream_block_score(spark, sf, carry=0):
    folder = sinks.new_folder(spark, "scans")
    scan_rows(spark, sf).orderBy("scan_idx").write.parquet(folder)
    stream = scans.read_files(spark, folder, scans.SCAN_SCHEMA)
    out = sinks.new_folder(spark, "labels")
    sinks.append_parquet(live.stream_score(stream, fixed_block_model(), SCAN_BLOCK, carry), out)
    return sinks.result(spark, out, live.OUTPUT)


query("stream_block_score", SCORE_SQL)(stream_block_score)
query("stream_block_score_carry")(
    lambda spark, sf: stream_block_score(spark, sf, carry=C.SAMPLING_RATE)
)
query(
    "block_feedback",
    f"""SELECT recording_id, block_id, '{{"left":' || (label = 1)::VARCHAR || ',"movement":true,"right":' ||
  (label = 1)::VARCHAR || '}}' AS "value" FROM ({SCORE_SQL})""",
)(
    lambda spark, sf: live.feedback(
        live.score_blocks(scan_rows(spark, sf), fixed_block_model(), SCAN_BLOCK)
    )
)

# --- ingest ----------------------------------------------------------------

LOW, HIGH, PER_FILE = -1000.0, 1000.0, 500


def edf_folder(spark, sf):
    """Recording files of every 500 samples of a channel, with a note on each value over 100, written by tasks."""
    folder = sinks.new_folder(spark, "recordings")

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("sample_idx")
        rec, channel, part = (rows.column(c)[0].as_py() for c in ("recording_id", "channel", "part"))
        at, values = rows.column("sample_idx").to_numpy(), rows.column("value").to_numpy()
        notes = [(float(i % PER_FILE), 0.5, f"{channel}-{i}") for i in at[values > 100].tolist()]
        path = f"{folder}/{rec}_{channel}_{part}.edf"
        edf.write_file(path, edf.encode({channel: values}, notes, 1, LOW, HIGH))
        return pa.table({"path": [path]})

    files = (
        views.samples(spark, sf)
        .withColumn("part", F.floor(F.col("sample_idx") / PER_FILE))
        .groupBy("recording_id", "channel", "part")
        .applyInArrow(write, "path string")
    )
    files.write.parquet(f"{folder}/written")  # a sub-folder, which the source leaves out
    return folder


def ingest_recordings(spark, sf):
    """Files to rows through the data source of the bulk job."""
    decoded = edf.read_recordings(spark, edf_folder(spark, sf))
    name = F.regexp_extract("path", r"([^/]+)_([^/_]+)_(\d+)\.edf$", 1).alias("recording_id")
    part = F.regexp_extract("path", r"_(\d+)\.edf$", 1).cast("long") * PER_FILE
    chunks = decoded.filter(F.col("kind") == "samples").select(
        name,
        F.lit("samples").alias("kind"),
        "channel",
        part.alias("_part"),
        "start_idx",
        F.posexplode("values").alias("_pos", "_v"),
    )
    rows = chunks.select(
        "recording_id",
        "kind",
        "channel",
        (F.col("_part") + F.col("start_idx") + F.col("_pos")).alias("sample_idx"),
        (F.round("_v", 6) + 0.0).alias("value"),
    )
    notes = decoded.filter(F.col("kind") == "annotation").select(
        name,
        "kind",
        F.split_part("label", F.lit("-"), F.lit(1)).alias("channel"),
        (part + F.col("onset_s").cast("long")).alias("sample_idx"),
        F.col("duration_s").alias("value"),
    )
    return rows.unionByName(notes)


query(
    "ingest_recordings",
    with_ctes(views.SAMPLES_SQL)
    + f"""SELECT recording_id, 'samples' AS kind, channel, sample_idx,
  round(({half_even('(value - -1000.0) * (65535 / 2000.0) - 32768', 0)} + 32768) * (2000.0 / 65535) - 1000.0, 6)
    + 0.0 AS value FROM samples
UNION ALL
SELECT recording_id, 'annotation', channel, sample_idx, 0.5 FROM samples WHERE value > 100""",
)(ingest_recordings)
