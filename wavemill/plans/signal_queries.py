"""Registered queries: events, epochs, filters and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions.taps import default_transitions, hamming_length
from wavemill.operators import channels, events, signal
from wavemill.plans.sqltext import half_even, with_ctes
from wavemill.registry import query
from wavemill.sources import views
from wavemill.sources.tables import table

RATE = C.SAMPLING_RATE
VIEW_RATE = views.VIEW_RATE
# tmin 1 s .. tmax 3 s, both ends included.
FIRST, LAST = VIEW_RATE, 3 * VIEW_RATE

# --- events ----------------------------------------------------------------

LABELS_SQL = f"""labelled AS (
  SELECT 'rec' || (user_id % 10) AS recording_id, event_id,
         CAST({half_even('value * 250', 0)} AS BIGINT) AS onset_idx,
         CAST(dense_rank() OVER (PARTITION BY user_id % 10 ORDER BY event_type) AS INTEGER) AS class_id
  FROM events)"""

query("encode_labels", with_ctes(LABELS_SQL) + "SELECT * FROM labelled")(
    lambda spark, sf: events.encode_labels(
        views.sample_rows(spark, sf).select(
            "recording_id",
            "event_id",
            F.col("channel").alias("label"),
            F.col("value").alias("onset_s"),
        )
    ).select("recording_id", "event_id", "onset_idx", "class_id")
)

SUB_EVENTS_SQL = f"""sub_events AS (
  SELECT recording_id, annotation_id, label, CAST(i AS INTEGER) AS sub_id,
         onset_idx + {VIEW_RATE} + i * 4 * {VIEW_RATE} AS onset_idx
  FROM annotations, range(0, 2) r(i)),
epoch_events AS (
  SELECT *, annotation_id * 2 + sub_id AS epoch_id FROM sub_events)"""


def sub_events(spark, sf):
    return events.sub_events(views.annotations(spark, sf), VIEW_RATE)


def epoch_events(spark, sf):
    return sub_events(spark, sf).withColumn("epoch_id", F.col("annotation_id") * 2 + F.col("sub_id"))


query(
    "sub_events",
    with_ctes(views.ANNOTATIONS_SQL, SUB_EVENTS_SQL)
    + "SELECT recording_id, annotation_id, label, sub_id, onset_idx FROM sub_events",
)(sub_events)

EPOCHS_SQL = f"""epochs AS (
  SELECT e.recording_id, e.epoch_id, s.channel, CAST(s.sample_idx - e.onset_idx - {FIRST} AS INTEGER) AS t,
         s.value, count(*) OVER (PARTITION BY e.recording_id, e.epoch_id, s.channel) AS n
  FROM epoch_events e JOIN samples s ON s.recording_id = e.recording_id
    AND s.sample_idx BETWEEN e.onset_idx + {FIRST} AND e.onset_idx + {LAST}
  QUALIFY n = {LAST - FIRST + 1})"""
EPOCH_CTES = with_ctes(views.SAMPLES_SQL, views.ANNOTATIONS_SQL, SUB_EVENTS_SQL, EPOCHS_SQL)


def epochs(spark, sf):
    return events.epoch_extract(
        views.samples(spark, sf),
        epoch_events(spark, sf).select("recording_id", "epoch_id", "onset_idx"),
        FIRST,
        LAST,
    ).select("recording_id", "epoch_id", "channel", "t", "value")


query("epoch_extract", EPOCH_CTES + "SELECT recording_id, epoch_id, channel, t, value FROM epochs")(
    epochs
)

query(
    "epoch_crop",
    EPOCH_CTES
    + "SELECT recording_id, epoch_id, channel, t, value FROM epochs WHERE t BETWEEN 2 AND 6",
)(lambda spark, sf: events.epoch_crop(epochs(spark, sf), 2, 6))

query(
    "epoch_arrays",
    EPOCH_CTES
    + """SELECT recording_id, epoch_id, channel, array_to_string(list(value ORDER BY t), ',') AS "values"
FROM epochs GROUP BY ALL""",
)(
    lambda spark, sf: events.epoch_arrays(
        epochs(spark, sf), ["recording_id", "epoch_id", "channel"]
    ).withColumn("values", F.array_join(F.col("values").cast("array<string>"), ","))
)

query(
    "relabel_hierarchy",
    """SELECT event_id, CAST(user_id % 3 AS INTEGER) AS class_id,
  CAST(CASE user_id % 3 WHEN 2 THEN 1 ELSE user_id % 3 END AS INTEGER) AS stage1,
  CAST(CASE WHEN user_id % 3 <> 0 THEN user_id % 3 END AS INTEGER) AS stage2 FROM events""",
)(
    lambda spark, sf: events.relabel_hierarchy(
        table(spark, sf, "events").select(
            "event_id", (F.col("user_id") % 3).cast("int").alias("class_id")
        )
    )
)

# Running windows over the nine epoch samples: length 4, step 2.
WINDOW, STEP, N_TIMES = VIEW_RATE, VIEW_RATE // 2, LAST - FIRST + 1
query(
    "sliding_windows",
    EPOCH_CTES
    + f"""SELECT recording_id, epoch_id, channel, CAST(w AS INTEGER) AS window_id,
  round((w * {STEP} + {WINDOW} / 2.0) / {VIEW_RATE} + 1.0, 6) AS center_s,
  round(sum(value * value), 6) AS energy, count(*) AS n
FROM epochs JOIN range(0, {len(events.window_starts(N_TIMES, WINDOW, STEP))}) r(w)
  ON t >= w * {STEP} AND t < w * {STEP} + {WINDOW} GROUP BY ALL""",
)(
    lambda spark, sf: events.sliding_sums(
        epochs(spark, sf),
        ["recording_id", "epoch_id", "channel"],
        N_TIMES,
        WINDOW,
        STEP,
        {"energy": F.col("value") * F.col("value")},
    ).select(
        "recording_id",
        "epoch_id",
        "channel",
        "window_id",
        F.round(events.window_center(F.col("window_id"), WINDOW, STEP, VIEW_RATE, 1.0), 6).alias(
            "center_s"
        ),
        F.round("energy", 6).alias("energy"),
        F.col("n").cast("long").alias("n"),
    )
)

# --- blocks ----------------------------------------------------------------

BLOCK = 10
query(
    "tumbling_blocks",
    with_ctes(views.SAMPLES_SQL)
    + f"""SELECT recording_id, channel, sample_idx // {BLOCK} AS block_id,
  round(sum(value), 6) AS total, count(*) AS scans FROM samples GROUP BY ALL HAVING count(*) = {BLOCK}""",
)(
    lambda spark, sf: events.tumbling_blocks(
        views.samples(spark, sf), BLOCK, [F.round(F.sum("value"), 6).alias("total")]
    )
)

query(
    "first_n_blocks",
    with_ctes(views.SAMPLES_SQL)
    + f"""SELECT recording_id, channel, sample_idx // {BLOCK} AS block_id, max(value) AS peak,
  count(*) AS scans FROM samples WHERE sample_idx < {BLOCK * C.LIVE_BLOCK_LIMIT} GROUP BY ALL
HAVING count(*) = {BLOCK}""",
)(
    lambda spark, sf: events.first_blocks(
        events.tumbling_blocks(views.samples(spark, sf), BLOCK, [F.max("value").alias("peak")])
    )
)

query(
    "block_envelope",
    with_ctes(views.SAMPLES_SQL)
    + f"""SELECT recording_id, CASE WHEN channel = 'error' THEN 1 ELSE 0 END AS channel_group,
  sample_idx // {BLOCK} AS block_id, min(value) AS low, max(value) AS high,
  round(min(value) - 0.05 * (max(value) - min(value)), 6) AS axis_low,
  round(max(value) + 0.05 * (max(value) - min(value)), 6) AS axis_high
FROM samples GROUP BY ALL""",
)(
    lambda spark, sf: events.block_envelope(
        views.samples(spark, sf),
        BLOCK,
        F.when(F.col("channel") == "error", 1).otherwise(0),
    )
    .withColumn("axis_low", F.round("axis_low", 6))
    .withColumn("axis_high", F.round("axis_high", 6))
)

LEVELS = 3
query(
    "envelope_pyramid",
    with_ctes(views.SAMPLES_SQL)
    + f"""SELECT CAST(level AS INTEGER) AS level, recording_id, CASE WHEN channel = 'error' THEN 1 ELSE 0 END AS channel_group,
  sample_idx // ({BLOCK} * CAST(2 ** level AS BIGINT)) AS block_id, min(value) AS low, max(value) AS high,
  round(min(value) - 0.05 * (max(value) - min(value)), 6) AS axis_low,
  round(max(value) + 0.05 * (max(value) - min(value)), 6) AS axis_high
FROM samples, range(0, {LEVELS}) r(level) GROUP BY ALL""",
)(
    lambda spark, sf: events.envelope_pyramid(
        views.samples(spark, sf),
        BLOCK,
        F.when(F.col("channel") == "error", 1).otherwise(0),
        LEVELS,
    )
    .withColumn("axis_low", F.round("axis_low", 6))
    .withColumn("axis_high", F.round("axis_high", 6))
)

query(
    "scan_to_long",
    """SELECT vec_id AS scan_idx, 'ch' || (p - 1) AS channel, CAST(embedding[p] AS DOUBLE) AS value
FROM embeddings, range(1, 33) r(p)""",
)(
    lambda spark, sf: channels.scan_to_long(
        table(spark, sf, "embeddings").select(
            F.col("vec_id").alias("scan_idx"), F.col("embedding").alias("ch")
        ),
        [f"ch{i}" for i in range(32)],
        ["scan_idx"],
    )
)

query(
    "common_average_reference",
    with_ctes(views.SAMPLES_SQL)
    + """SELECT recording_id, channel, sample_idx,
  round(value - avg(value) OVER (PARTITION BY recording_id, sample_idx), 6) + 0.0 AS value FROM samples""",
)(
    lambda spark, sf: channels.common_average_reference(views.samples(spark, sf)).select(
        "recording_id", "channel", "sample_idx", (F.round("value", 6) + 0.0).alias("value")
    )
)

# --- filters ---------------------------------------------------------------


def taps_sql(low: float, high: float, low_width: float, high_width: float, rate: int) -> str:
    """Band-pass taps by offset k, written out from the window formula."""
    sides = [
        (high + high_width / 2, hamming_length(high_width, rate), 1.0),
        (low - low_width / 2, hamming_length(low_width, rate), -1.0),
    ]
    parts = []
    for cutoff, n, sign in sides:
        fc = 2.0 * cutoff / rate
        half = n // 2
        parts.append(
            f"""SELECT k, {sign} * w / sum(w) OVER () AS h FROM (
      SELECT k, (CASE WHEN k = 0 THEN {fc} ELSE sin(pi() * {fc} * k) / (pi() * k) END)
             * (0.54 + 0.46 * cos(2 * pi() * k / {n - 1})) AS w FROM range(-{half}, {half + 1}) r(k))"""
        )
    return f"SELECT k, sum(h) AS h FROM ({' UNION ALL '.join(parts)}) GROUP BY k"


MIRROR_SQL = """edges AS (
  SELECT recording_id, channel, max(sample_idx) AS last, arg_min(value, sample_idx) AS va,
         arg_max(value, sample_idx) AS vz FROM samples GROUP BY ALL),
extended AS (
  SELECT recording_id, channel, sample_idx, value FROM samples
  UNION ALL SELECT s.recording_id, s.channel, -s.sample_idx, 2 * va - value
    FROM samples s JOIN edges USING (recording_id, channel) WHERE s.sample_idx > 0
  UNION ALL SELECT s.recording_id, s.channel, 2 * last - s.sample_idx, 2 * vz - value
    FROM samples s JOIN edges USING (recording_id, channel) WHERE s.sample_idx < last)"""


def filtered_sql(source: str) -> str:
    return f"""filtered AS (
  SELECT s.recording_id, s.channel, band_id, s.sample_idx, sum(h.h * x.value) AS value
  FROM samples s JOIN {source} x ON x.recording_id = s.recording_id AND x.channel = s.channel
  JOIN taps h ON h.k = s.sample_idx - x.sample_idx
  GROUP BY s.recording_id, s.channel, band_id, s.sample_idx)"""


query(
    "fir_bandpass",
    with_ctes(
        views.SAMPLES_SQL,
        MIRROR_SQL,
        f"taps AS (SELECT 0 AS band_id, * FROM ({taps_sql(14, 20, 2, 2, RATE)}))",
        filtered_sql("extended"),
    )
    + "SELECT recording_id, channel, sample_idx, round(value, 6) + 0.0 AS value FROM filtered",
)(
    lambda spark, sf: signal.fir_bandpass(views.samples(spark, sf), *C.LIVE_BAND).withColumn(
        "value", F.round("value", 6) + 0.0
    )
)

BANK = [(0, 2.0, 3.0), (1, 8.0, 12.0), (2, 14.0, 20.0), (3, 29.0, 36.0)]
query(
    "filter_bank",
    with_ctes(
        views.SAMPLES_SQL,
        "taps AS ("
        + " UNION ALL ".join(
            f"SELECT {b} AS band_id, * FROM ({taps_sql(lo, hi, 2, 2, RATE)})" for b, lo, hi in BANK
        )
        + ")",
        filtered_sql("samples"),
    )
    + "SELECT recording_id, channel, band_id, sample_idx, round(value, 6) + 0.0 AS value FROM filtered",
)(
    lambda spark, sf: signal.filter_bank(
        views.samples(spark, sf), BANK, edge="zero"
    ).withColumn("value", F.round("value", 6) + 0.0)
)

SELECTED = ["click", "view", "error", "absent"]


def channel_report(spark, sf):
    """Channels scaled so that some of them fall under the threshold."""
    scaled = views.samples(spark, sf).withColumn(
        "value",
        F.when(F.col("channel").isin("error", "signup"), F.col("value") * 1e-20).otherwise(
            F.col("value")
        ),
    )
    power = channels.channel_power(signal.broad_bandpass(scaled))
    return channels.channel_validation(power, SELECTED).unionByName(
        channels.missing_selected(power, SELECTED)
    )


LOW_W, HIGH_W = default_transitions(2.0, 40.0, RATE)
query(
    "channel_validation",
    with_ctes(
        views.SAMPLES_SQL.replace("samples AS", "raw AS", 1),
        """samples AS (SELECT * REPLACE (CASE WHEN channel IN ('error', 'signup') THEN value * 1e-20
    ELSE value END AS value) FROM raw)""",
        MIRROR_SQL,
        f"taps AS (SELECT 0 AS band_id, * FROM ({taps_sql(2, 40, LOW_W, HIGH_W, RATE)}))",
        filtered_sql("extended"),
        "power AS (SELECT recording_id, channel, avg(abs(value)) AS power FROM filtered GROUP BY ALL)",
    )
    + """SELECT recording_id, channel,
  CASE WHEN channel IN ('click', 'view', 'error') THEN 'selected' ELSE 'additional' END AS role,
  CASE WHEN power > 1e-15 THEN 'valid' ELSE 'invalid' END AS state FROM power
UNION ALL
SELECT DISTINCT recording_id, 'absent', 'selected', 'not found' FROM power""",
)(channel_report)

MORLET_HZ = [float(f) for f in range(5, 30)]


def waves_sql(frequencies: str) -> str:
    return f"""waves AS (
  SELECT f, k, cos(2 * pi() * f * k / {RATE}) * g / norm AS re, sin(2 * pi() * f * k / {RATE}) * g / norm AS im
  FROM (SELECT *, sqrt(0.5) * sqrt(sum(g * g) OVER (PARTITION BY f)) AS norm
        FROM (SELECT f, k, exp(0 - pow(k / {RATE}.0, 2) / (2 * s * s)) AS g
              FROM (SELECT CAST(f AS DOUBLE) AS f, 5 / (2 * pi() * f) AS s FROM {frequencies} a(f)),
                   range(-250, 251) b(k)
              WHERE abs(k) < ceil(5 * s * {RATE}))))"""


TRANSFORM_SQL = """tfr AS (
  SELECT s.recording_id, s.channel, f AS frequency, s.sample_idx, sum(re * x.value) AS re,
         sum(im * x.value) AS im
  FROM samples s JOIN samples x ON x.recording_id = s.recording_id AND x.channel = s.channel
  JOIN waves ON k = s.sample_idx - x.sample_idx
  GROUP BY s.recording_id, s.channel, f, s.sample_idx)"""

query(
    "morlet_power",
    with_ctes(views.SAMPLES_SQL, waves_sql("range(5, 30)"), TRANSFORM_SQL)
    + """SELECT recording_id, channel, frequency, count(*) AS n, round(avg(re ** 2 + im ** 2), 4) AS power,
  round(max(re ** 2 + im ** 2), 4) AS peak FROM tfr GROUP BY ALL""",
)(
    lambda spark, sf: signal.morlet_power(views.samples(spark, sf), MORLET_HZ, RATE, 5.0)
    .groupBy("recording_id", "channel", "frequency")
    .agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("power"), 4).alias("power"),
        F.round(F.max("power"), 4).alias("peak"),
    )
)

query(
    "morlet_transform",
    with_ctes(views.SAMPLES_SQL, waves_sql("(VALUES (10), (20))"), TRANSFORM_SQL)
    + """SELECT recording_id, channel, frequency, sample_idx, round(re, 6) + 0.0 AS re,
  round(im, 6) + 0.0 AS im FROM tfr""",
)(
    lambda spark, sf: signal.morlet_transform(
        views.samples(spark, sf), [10.0, 20.0], RATE, 5.0
    ).select(
        "recording_id",
        "channel",
        "frequency",
        "sample_idx",
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")],
    )
)

query(
    "magnitude_spectrum",
    with_ctes(views.epochs_sql())
    + """SELECT epoch_id, channel, CAST(f AS INTEGER) AS bin,
  round(sqrt(sum(value * cos(2 * pi() * f * t / 8)) ** 2 + sum(value * sin(2 * pi() * f * t / 8)) ** 2), 6)
    + 0.0 AS magnitude
FROM tensor, range(0, 5) r(f) GROUP BY epoch_id, channel, f""",
)(
    lambda spark, sf: signal.magnitude_spectrum(views.epochs(spark, sf))
    .select("epoch_id", F.posexplode("data").alias("pos", "value"))
    .select(
        "epoch_id",
        F.floor(F.col("pos") / 5).cast("int").alias("channel"),
        (F.col("pos") % 5).cast("int").alias("bin"),
        (F.round("value", 6) + 0.0).alias("magnitude"),
    )
)

query(
    "reshape_array",
    """SELECT vec_id AS epoch_id, CAST((p - 1) // 8 AS INTEGER) AS channel,
  array_to_string([CAST(embedding[q] AS DOUBLE) * 1024 FOR q IN range(p + 2, p + 6)]::BIGINT[], ',') AS cut
FROM embeddings, range(1, 65, 8) r(p)""",
)(
    lambda spark, sf: views.epochs(spark, sf)
    .select(
        "epoch_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("data", c * 8 + 3, F.lit(4))
            )
        ).alias("channel", "part"),
    )
    .select(
        "epoch_id",
        "channel",
        F.array_join(
            F.transform("part", lambda v: F.rint(v * 1024).cast("long").cast("string")), ","
        ).alias("cut"),
    )
)
