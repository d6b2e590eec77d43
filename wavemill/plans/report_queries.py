"""Registered queries: reports, grids, scalar functions, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions import scalars
from wavemill.operators import aggregate, channels, events, grid, report, throttle
from wavemill.plans.sqltext import half_even, with_ctes
from wavemill.registry import query
from wavemill.sources import tabular, views
from wavemill.sources.tables import table
from wavemill.streaming.sinks import new_folder

DROPPED = "2024-01-08"

KEYS_SQL = "participant, task, date, classifier, frequency, configuration, frequency_start, frequency_end"
NOT_NULL_SQL = " AND ".join(f"{k} IS NOT NULL" for k in KEYS_SQL.split(", "))
KEPT_SQL = f"""kept AS (
  SELECT * FROM results WHERE NOT coalesce(contains(date, '{DROPPED}'), false))"""
CELLS_SQL = f"""cells AS (
  SELECT {KEYS_SQL}, avg(CASE WHEN NOT isnan(accuracy) THEN accuracy END) AS accuracy
  FROM kept WHERE {NOT_NULL_SQL} GROUP BY ALL)"""
BEST_SQL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY participant, task, classifier
                               ORDER BY accuracy DESC) AS rn
  FROM cells WHERE accuracy IS NOT NULL AND NOT isnan(accuracy)),
best AS (
  SELECT participant, task, classifier, {half_even('avg(accuracy)')} AS accuracy
  FROM ranked WHERE rn <= 20 GROUP BY ALL)"""
# Exact sum of three-decimal doubles, see report.mean_of_rounded.
EXACT_MEAN = f"CAST(sum(CAST(accuracy * {2.0**62!r} AS BIGINT)) AS DOUBLE) / {2.0**62!r} / count(accuracy)"
REPORT_CTES = with_ctes(views.RESULTS_SQL, KEPT_SQL, CELLS_SQL, BEST_SQL)


def kept(spark, sf):
    return report.drop_matching_keep_null(views.results(spark, sf), "date", DROPPED)


def best(spark, sf):
    return report.topk_mean(report.mean_over_splits(kept(spark, sf)))


query(
    "drop_matching_keep_null",
    with_ctes(views.RESULTS_SQL, KEPT_SQL)
    + "SELECT participant, task, date, classifier, accuracy, frequency FROM kept",
)(
    lambda spark, sf: kept(spark, sf).select(
        "participant", "task", "date", "classifier", "accuracy", "frequency"
    )
)

query(
    "mean_over_splits",
    with_ctes(views.RESULTS_SQL, KEPT_SQL, CELLS_SQL)
    + f"SELECT {KEYS_SQL}, round(accuracy, 9) AS accuracy FROM cells",
)(
    lambda spark, sf: report.mean_over_splits(kept(spark, sf)).withColumn(
        "accuracy", F.round("accuracy", 9)
    )
)

query("topk_mean", REPORT_CTES + "SELECT * FROM best")(best)

# The same report by an aggregate of the caller's own.
query("user_aggregate", REPORT_CTES + "SELECT * FROM best")(
    lambda spark, sf: aggregate.aggregate(
        report.mean_over_splits(kept(spark, sf)), report.GROUP, aggregate.mean_of_largest("accuracy", report.TOP, "accuracy")
    ).withColumn("accuracy", scalars.round_half_even(F.col("accuracy")))
)

query(
    "method_difference",
    REPORT_CTES
    + f"""SELECT c.participant, c.task, {half_even('c.accuracy - o.accuracy')} AS diff
FROM best c LEFT JOIN best o
  ON o.participant = c.participant AND o.task = c.task AND o.classifier <> 'csp'
WHERE c.classifier = 'csp'""",
)(lambda spark, sf: report.method_difference(best(spark, sf)))

query(
    "mean_over_participants",
    REPORT_CTES
    + f"SELECT task, classifier, {half_even(EXACT_MEAN)} AS accuracy FROM best GROUP BY ALL",
)(lambda spark, sf: report.mean_over_participants(best(spark, sf)))

query(
    "mean_by_family",
    REPORT_CTES
    + f"""SELECT participant,
  CASE WHEN task[1:4] = 'imag' THEN 'imagery' WHEN task[1:4] = 'real' THEN 'real'
       ELSE 'observation' END AS type,
  {half_even(EXACT_MEAN)} AS accuracy
FROM best GROUP BY ALL""",
)(lambda spark, sf: report.mean_by_family(best(spark, sf)))



def csv_round_trip(spark, sf):
    """Best-cell report written as CSV with a running index and read back."""
    folder = new_folder(spark, "report")
    tabular.write_csv(best(spark, sf), folder, ["participant", "task", "classifier"])
    schema = "row_index bigint, participant string, task string, classifier string, accuracy double"
    return tabular.read_csv(spark, folder, schema, with_index=False)


query(
    "csv_round_trip",
    REPORT_CTES
    + """SELECT row_number() OVER (ORDER BY participant, task, classifier) - 1 AS row_index,
  participant, task, classifier, accuracy FROM best""",
)(csv_round_trip)

query(
    "accuracy_curve",
    with_ctes(
        views.RESULTS_SQL,
        """usable AS (SELECT * REPLACE (CASE WHEN NOT isnan(accuracy) THEN accuracy END AS accuracy)
  FROM results)""",
    )
    + """SELECT configuration, frequency, round(avg(accuracy), 9) AS mean,
  round(stddev_samp(accuracy), 9) AS sd,
  round(avg(accuracy) - stddev_samp(accuracy), 9) AS low,
  round(avg(accuracy) + stddev_samp(accuracy), 9) AS high
FROM usable GROUP BY ALL""",
)(
    lambda spark, sf: report.accuracy_curve(views.results(spark, sf)).select(
        "configuration", "frequency", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "low", "high")]
    )
)

query(
    "reorder_columns",
    with_ctes(views.RESULTS_SQL)
    + "SELECT participant, classifier, 'run1' AS run, task, accuracy, frequency FROM results",
)(
    lambda spark, sf: report.with_keys_first(
        views.results(spark, sf).select("task", "accuracy", "participant", "frequency", "classifier"),
        ["participant", "classifier", "run"],
        run="run1",
    )
)

query(
    "union_results",
    with_ctes(views.RESULTS_SQL)
    + "SELECT participant, task, classifier, accuracy FROM results",
)(
    lambda spark, sf: report.union_results(
        [
            views.results(spark, sf)
            .filter(F.col("classifier") == m)
            .select("participant", "task", "classifier", "accuracy")
            for m in ("csp", "parafac")
        ]
    )
)

query(
    "round_half_even",
    f"SELECT event_id, {half_even('value / 20.0')} AS r3, {half_even('value / 8.0', 1)} AS r1 FROM events",
)(
    lambda spark, sf: table(spark, sf, "events").select(
        "event_id",
        scalars.round_half_even(F.col("value") / 20.0).alias("r3"),
        scalars.round_half_even(F.col("value") / 8.0, 1).alias("r1"),
    )
)

# --- names and paths -------------------------------------------------------

PATHS_SQL = """paths AS (
  SELECT event_id, 'data_' || (CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 's' END) || '/' ||
         strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_' || event_type ||
         (CASE event_id % 4 WHEN 0 THEN '.edf' WHEN 1 THEN '.EDF' WHEN 2 THEN '.edf' ELSE '.edf.bak' END)
           AS path
  FROM events)"""


def paths(spark, sf):
    suffix = (
        F.when(F.col("event_id") % 4 == 1, ".EDF")
        .when(F.col("event_id") % 4 == 3, ".edf.bak")
        .otherwise(".edf")
    )
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.when(F.col("user_id") % 2 == 0, "data_b").otherwise("data_s"),
            F.lit("/"),
            scalars.recording_stamp(F.col("ts")),
            F.lit("_"),
            "event_type",
            suffix,
        ).alias("path"),
    )


query(
    "path_filter", with_ctes(PATHS_SQL) + "SELECT event_id, path FROM paths WHERE path[-4:] = '.edf'"
)(lambda spark, sf: paths(spark, sf).filter(F.col("path").endswith(".edf")))

query(
    "file_count",
    with_ctes(PATHS_SQL)
    + "SELECT split_part(path, '/', 1) AS participant, count(*) AS files FROM paths "
    "WHERE path[-4:] = '.edf' GROUP BY ALL",
)(
    lambda spark, sf: paths(spark, sf)
    .filter(F.col("path").endswith(".edf"))
    .groupBy(scalars.path_participant(F.col("path")).alias("participant"))
    .agg(F.count(F.lit(1)).alias("files"))
)

query(
    "parse_recording_path",
    with_ctes(PATHS_SQL)
    + """SELECT event_id, split_part(path, '/', 1) AS participant, path[8:26] AS date,
  path[28:length(path) - 4] AS task FROM paths WHERE path[-4:] = '.edf'""",
)(
    lambda spark, sf: paths(spark, sf)
    .filter(F.col("path").endswith(".edf"))
    .select(
        "event_id",
        scalars.path_participant(F.col("path")).alias("participant"),
        scalars.path_date(F.col("path")).alias("date"),
        scalars.path_task(F.col("path")).alias("task"),
    )
)

query(
    "recording_name",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS name FROM events",
)(
    lambda spark, sf: table(spark, sf, "events").select(
        "event_id", scalars.recording_stamp(F.col("ts")).alias("name")
    )
)

query(
    "parse_json_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)(
    lambda spark, sf: table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k")
    )
)

query(
    "feedback_json",
    """SELECT event_id, '{' ||
  (CASE WHEN event_type <> 'view' THEN '"left":' || (event_type = 'click')::VARCHAR || ',' ELSE '' END) ||
  '"movement":' || (event_type <> 'error')::VARCHAR ||
  (CASE WHEN event_type <> 'view' THEN ',"right":' || (event_type = 'click')::VARCHAR ELSE '' END) || '}'
  AS message FROM events""",
)(
    lambda spark, sf: table(spark, sf, "events").select(
        "event_id",
        scalars.to_sorted_json(
            {
                "right": F.when(F.col("event_type") != "view", F.col("event_type") == "click"),
                "left": F.when(F.col("event_type") != "view", F.col("event_type") == "click"),
                "movement": F.col("event_type") != "error",
            }
        ).alias("message"),
    )
)

# --- grids and schedules ---------------------------------------------------


def nation_configs(spark, sf):
    """Configurations with a width per region and the nations of the region as channels."""
    regions = table(spark, sf, "region").select("r_regionkey")
    named = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_set("n_name").alias("c"))
    return regions.join(named, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        F.col("r_regionkey").cast("int").alias("config_id"),
        F.when(F.col("r_regionkey") == 0, F.array().cast("array<string>"))
        .otherwise(F.coalesce("c", F.array().cast("array<string>")))
        .alias("channels"),
        (F.col("r_regionkey") + 1).cast("int").alias("band_width"),
    )


CONFIGS_SQL = """configs AS (
  SELECT CAST(r_regionkey AS INTEGER) AS config_id,
         CASE WHEN r_regionkey = 0 THEN 0 ELSE count(n_name) END AS n,
         CAST(r_regionkey + 1 AS INTEGER) AS band_width
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)"""
LABEL_SQL = "band_width || 'Hz width ' || (CASE WHEN n = 0 THEN 'all' ELSE n::VARCHAR END) || ' channels'"

query(
    "configuration_label",
    with_ctes(CONFIGS_SQL) + f"SELECT config_id, {LABEL_SQL} AS configuration FROM configs",
)(
    lambda spark, sf: nation_configs(spark, sf).select(
        "config_id",
        scalars.configuration_label(F.col("band_width"), F.col("channels")).alias("configuration"),
    )
)

query(
    "sweep_grid",
    """SELECT s_suppkey AS recording_id, m AS classifier, w || 'Hz width 11 channels' AS configuration,
  (f + f + w) / 2.0 AS frequency, CAST(f AS INTEGER) AS frequency_start,
  CAST(f + w AS INTEGER) AS frequency_end
FROM supplier, (VALUES ('csp'), ('parafac')) ms(m), range(2, 30) r(f), range(1, 8) v(w)""",
)(
    lambda spark, sf: grid.sweep_grid(
        grid.with_methods(
            table(spark, sf, "supplier").select(F.col("s_suppkey").alias("recording_id")),
            ["csp", "parafac"],
        )
    )
)

query(
    "trial_schedule",
    """WITH t AS (
  SELECT c_custkey AS session_id, CAST(k AS INTEGER) AS trial, label
  FROM customer, range(0, 10) r(k), (VALUES ('movement'), ('rest')) l(label))
SELECT session_id, trial, label, CAST(row_number() OVER (PARTITION BY session_id
  ORDER BY md5('42:' || session_id || ':' || trial || ':' || label)) AS INTEGER) AS position FROM t""",
)(
    lambda spark, sf: grid.trial_schedule(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"))
    )
)

# --- catalogs --------------------------------------------------------------

query(
    "channel_mask",
    """SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS available,
  l_returnflag = 'N' AS requested, l_linestatus = 'O' AND l_returnflag = 'N' AS acquire FROM lineitem""",
)(
    lambda spark, sf: channels.channel_mask(
        table(spark, sf, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            (F.col("l_linestatus") == "O").alias("available"),
            (F.col("l_returnflag") == "N").alias("requested"),
        ),
        F.col("available"),
        F.col("requested"),
    )
)

query(
    "lookup_with_default",
    """SELECT n_nationkey, CAST(CASE n_regionkey WHEN 0 THEN 8 WHEN 1 THEN 15 WHEN 2 THEN 16 WHEN 3 THEN 31
  ELSE 8 END AS INTEGER) AS scans FROM nation""",
)(
    lambda spark, sf: table(spark, sf, "nation").select(
        "n_nationkey",
        scalars.lookup_with_default(
            F.col("n_regionkey").cast("int"), {0: 8, 1: 15, 2: 16, 3: 31}, 8
        ).alias("scans"),
    )
)

query(
    "supported_block_sizes",
    """SELECT DISTINCT p_brand AS device, CAST(p_size * 250 AS INTEGER) AS rate,
  CAST(CASE p_size * 250 WHEN 250 THEN 8 WHEN 500 THEN 15 ELSE 8 END AS INTEGER) AS scans
FROM part WHERE p_size * 250 <> 4000""",
)(
    lambda spark, sf: table(spark, sf, "part")
    .select(F.col("p_brand").alias("device"), (F.col("p_size") * 250).cast("int").alias("rate"))
    .filter(F.col("rate") != C.INTERNAL_RATE)
    .distinct()
    .withColumn("scans", scalars.scans_per_block(F.col("rate")).cast("int"))
)

query(
    "scan_layout",
    with_ctes(views.LAYOUT_SQL)
    + """SELECT device, position,
  CAST(coalesce(sum(CASE WHEN enabled THEN width ELSE 0 END) OVER (PARTITION BY device ORDER BY position
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_column,
  CAST(sum(CASE WHEN enabled THEN width ELSE 0 END) OVER (PARTITION BY device ORDER BY position
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS index_after
FROM layout""",
)(lambda spark, sf: channels.scan_layout(views.layout_catalog(spark, sf)))

query(
    "nth_value_per_device",
    """SELECT device, rate FROM (
  SELECT device, rate, row_number() OVER (PARTITION BY device ORDER BY rate) AS rn
  FROM (SELECT DISTINCT p_brand AS device, p_size AS rate FROM part)) WHERE rn = 2""",
)(
    lambda spark, sf: channels.nth_lowest_rate(
        table(spark, sf, "part").select(
            F.col("p_brand").alias("device"), F.col("p_size").alias("rate")
        )
    )
)

query(
    "filter_catalog_match",
    """WITH filters AS (SELECT p_brand AS device, p_size AS rate, p_partkey AS filter_index
  FROM part WHERE p_type = 'ECONOMY'),
devices AS (SELECT p_partkey AS channel, p_brand AS device, p_size AS rate FROM part)
SELECT d.channel, d.device, d.rate, f.filter_index FROM devices d
LEFT JOIN (SELECT device, rate, min(filter_index) AS filter_index FROM filters GROUP BY ALL) f
  ON f.device = d.device AND f.rate = d.rate""",
)(
    lambda spark, sf: channels.filter_catalog_match(
        table(spark, sf, "part").select(
            F.col("p_partkey").alias("channel"),
            F.col("p_brand").alias("device"),
            F.col("p_size").alias("rate"),
        ),
        table(spark, sf, "part")
        .filter(F.col("p_type") == "ECONOMY")
        .select(
            F.col("p_brand").alias("device"),
            F.col("p_size").alias("rate"),
            F.col("p_partkey").alias("filter_index"),
        ),
    )
)

query(
    "channels_not_found",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
)(
    lambda spark, sf: channels.channels_not_found(
        table(spark, sf, "customer").select("c_custkey"),
        table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")),
        "c_custkey",
    )
)

query(
    "select_channels",
    with_ctes(views.SAMPLES_SQL)
    + "SELECT recording_id, channel, sample_idx, value FROM samples WHERE channel IN ('click', 'view', 'error')",
)(lambda spark, sf: channels.select_channels(views.samples(spark, sf), ["click", "view", "error"]))

# --- ordered streams, batch form -------------------------------------------

query(
    "change_only",
    with_ctes(views.COMMANDS_SQL)
    + """SELECT key, event_id, command FROM (
  SELECT *, lag(command) OVER (PARTITION BY key ORDER BY ts, event_id) AS prev FROM commands)
WHERE command IS DISTINCT FROM prev""",
)(
    lambda spark, sf: events.change_only(views.commands(spark, sf)).select(
        "key", "event_id", "command"
    )
)

query(
    "label_intervals",
    with_ctes(
        views.COMMANDS_SQL,
        """marked AS (SELECT *, row_number() OVER w - 1 AS idx,
  CASE WHEN lag(command) OVER w IS DISTINCT FROM command THEN 1 ELSE 0 END AS change
  FROM commands WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))""",
        """runs AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY idx) AS run FROM marked)""",
    )
    + """SELECT key, CAST(run AS BIGINT) AS run, command, min(idx) / 2.0 AS onset_s,
  count(*) / 2.0 AS duration_s FROM runs WHERE command <> 'view' GROUP BY key, run, command""",
)(
    lambda spark, sf: events.label_intervals(
        views.commands(spark, sf), "key", "command", ["ts", "event_id"], pause="view"
    )
)

query(
    "throttle_commands",
    """WITH RECURSIVE c AS (
  SELECT user_id AS key, event_id, event_type AS command, epoch_us(ts) AS t,
         CAST(round(value * 600.0 * 1000000) AS BIGINT) AS d,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT key, event_id, rn, true AS play, t + d AS busy, command AS last FROM c WHERE rn = 1
  UNION ALL
  SELECT c.key, c.event_id, c.rn, c.t >= w.busy AND c.command <> w.last,
         CASE WHEN c.t >= w.busy AND c.command <> w.last THEN c.t + c.d ELSE w.busy END,
         CASE WHEN c.t >= w.busy AND c.command <> w.last THEN c.command ELSE w.last END
  FROM walk w JOIN c ON c.key = w.key AND c.rn = w.rn + 1)
SELECT key, event_id FROM walk WHERE play""",
)(
    lambda spark, sf: throttle.throttle(views.commands(spark, sf)).select("key", "event_id")
)

query(
    "running_offset",
    """WITH blocks AS (
  SELECT 'rec' || (user_id % 10) AS recording_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day,
         count(*) AS scans FROM events GROUP BY ALL)
SELECT recording_id, CAST(day AS INTEGER) AS day, scans,
  CAST(coalesce(sum(scans) OVER (PARTITION BY recording_id ORDER BY day
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM blocks""",
)(
    lambda spark, sf: events.running_offset(
        views.sample_rows(spark, sf)
        .groupBy(
            "recording_id",
            F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"),
        )
        .agg(F.count(F.lit(1)).alias("scans")),
        ["recording_id"],
        "day",
        "scans",
    )
)
