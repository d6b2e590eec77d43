"""Registered queries: whole sweeps and the two-stage classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.operators import grid
from wavemill.plans import running, staged, sweep
from wavemill.plans.model_queries import discriminant_sql, two_channel_sql
from wavemill.plans.signal_queries import taps_sql
from wavemill.plans.sqltext import with_ctes
from wavemill.registry import query
from wavemill.sources import views

# Sampling rate given to the eight-sample epochs of the tensor view.
RATE = 80


def recordings(spark, sf):
    """Tensor view spread over five recordings."""
    return views.epochs(spark, sf).withColumn(
        "recording_id", F.concat(F.lit("rec"), (F.col("epoch_id") % 5).cast("string"))
    )


def swept(spark, sf, method, widths, channels=8):
    bands = grid.bands(widths=widths)
    blocks = recordings(spark, sf).withColumn("n_channels", F.lit(channels))
    scores = sweep.score_blocks(blocks, bands, method, rate=RATE)
    return sweep.result_rows(scores, sweep.grid_cells(spark, bands, channels), method)


# Sweeps on two channels have a closed form at every step, so that SQL can follow them whole: mirrored filter,
# covariances, filters, log powers, discriminant.  ``lists`` places the two channels of each list in the
# embedding, ``cells`` has (band_id, list, low, high).
CELL = "recording_id, band_id, split_id"


def sweep_ctes(times: int, lists: list[tuple[int, int]], cells: list[tuple[int, int, float, float]]) -> list[str]:
    channels = ", ".join(f"({i}, {a * times}, {b * times})" for i, (a, b) in enumerate(lists))
    where = ", ".join(f"({b}, {i})" for b, i, _, _ in cells)
    return [
        f"""x AS (
  SELECT 'rec' || (vec_id % 5) AS recording_id, vec_id AS epoch_id, label % 2 AS class_id, l,
         CAST(t AS INTEGER) AS t, CAST(embedding[t + 1 + a] AS DOUBLE) AS x0,
         CAST(embedding[t + 1 + b] AS DOUBLE) AS x1
  FROM embeddings, range(0, {times}) r(t), (VALUES {channels}) v(l, a, b))""",
        """ends AS (
  SELECT epoch_id, l, arg_min(x0, t) AS a0, arg_min(x1, t) AS a1, arg_max(x0, t) AS z0,
         arg_max(x1, t) AS z1 FROM x GROUP BY ALL)""",
        f"""e AS (
  SELECT epoch_id, l, t, x0, x1 FROM x
  UNION ALL SELECT epoch_id, l, -t, 2 * a0 - x0, 2 * a1 - x1 FROM x JOIN ends USING (epoch_id, l) WHERE t > 0
  UNION ALL SELECT epoch_id, l, {2 * times - 2} - t, 2 * z0 - x0, 2 * z1 - x1
    FROM x JOIN ends USING (epoch_id, l) WHERE t < {times - 1})""",
        "taps AS ("
        + " UNION ALL ".join(f"SELECT {b} AS band_id, * FROM ({taps_sql(lo, hi, 2, 2, RATE)})" for b, _, lo, hi in cells)
        + ")",
        f"cell AS (SELECT * FROM (VALUES {where}) v(band_id, l))",
        f"""y AS (
  SELECT epoch_id, taps.band_id, o.t, sum(h * x0) AS y0, sum(h * x1) AS y1
  FROM e CROSS JOIN range(0, {times}) o(t) JOIN taps ON k = o.t - e.t JOIN cell ON cell.band_id = taps.band_id AND cell.l = e.l
  GROUP BY ALL)""",
        """gram AS (
  SELECT epoch_id, band_id, sum(y0 * y0) AS g00, sum(y0 * y1) AS g01, sum(y1 * y1) AS g11
  FROM y GROUP BY ALL)""",
        """ids AS (SELECT DISTINCT recording_id, epoch_id, class_id FROM x)""",
        """splits AS (
  SELECT recording_id, class_id, epoch_id, CAST(split_id AS INTEGER) AS split_id,
         row_number() OVER (PARTITION BY recording_id, split_id
             ORDER BY md5('42:' || split_id || ':' || epoch_id), epoch_id)
         <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY recording_id, split_id)) AS test
  FROM ids, range(0, 10) r(split_id))""",
        f"""sums AS (
  SELECT {CELL}, class_id, sum(g00) / (count(*) * {times}) AS g00, sum(g01) / (count(*) * {times}) AS g01,
         sum(g11) / (count(*) * {times}) AS g11
  FROM gram JOIN splits USING (epoch_id) WHERE NOT test GROUP BY ALL)""",
        """cov AS (
  SELECT * EXCLUDE (g00, g01, g11), 0 AS i, 0 AS j, g00 AS value FROM sums
  UNION ALL SELECT * EXCLUDE (g00, g01, g11), 0, 1, g01 FROM sums
  UNION ALL SELECT * EXCLUDE (g00, g01, g11), 1, 1, g11 FROM sums)""",
        two_channel_sql(CELL),
        f"""powers AS (
  SELECT {CELL}, epoch_id, class_id, test, component,
         ln((w0 * w0 * g00 + 2 * w0 * w1 * g01 + w1 * w1 * g11) / {times}) AS f
  FROM gram JOIN splits USING (epoch_id) JOIN filters USING ({CELL}))""",
    ]


def rated_ctes(keys: str, features: str) -> list[str]:
    """Discriminant and predictions from two features for each row of ``keys``, epoch_id."""
    return [
        f"features AS (SELECT {keys}, epoch_id, class_id, test, {features} FROM powers GROUP BY {keys}, epoch_id, class_id, test)",
        f"""stats AS (
  SELECT {keys}, class_id, count(*) AS n, sum(f0) AS s0, sum(f1) AS s1, sum(f0 * f0) AS q00,
         sum(f0 * f1) AS q01, sum(f1 * f1) AS q11 FROM features WHERE NOT test GROUP BY ALL)""",
        discriminant_sql(keys),
        f"""predicted AS (
  SELECT {keys}, epoch_id, f.class_id AS actual, arg_max(l.class_id, b0 * f0 + b1 * f1 + b) AS predicted
  FROM features f JOIN lines l USING ({keys}) WHERE test GROUP BY ALL)""",
    ]


BOTH_COMPONENTS = "max(f) FILTER (component = 0) AS f0, max(f) FILTER (component = 1) AS f1"
ACCURACY = "count(*) FILTER (predicted = actual)::DOUBLE / count(*) AS accuracy"


def grid_sql(times, lists, cells, label) -> str:
    """Result rows of a sweep; ``label`` gives a cell's configuration."""
    rows = ", ".join(f"({b}, {lo}, {hi}, '{label(i, hi - lo)}')" for b, i, lo, hi in cells)
    grid_cte = f"grid AS (SELECT * FROM (VALUES {rows}) v(band_id, low, high, configuration))"
    return (
        with_ctes(*sweep_ctes(times, lists, cells), *rated_ctes(CELL, BOTH_COMPONENTS), grid_cte)
        + f"""SELECT recording_id, 'csp' AS classifier, split_id, {ACCURACY}, CAST((low + high) / 2.0 AS DOUBLE) AS frequency,
  configuration, CAST(low AS INTEGER) AS frequency_start, CAST(high AS INTEGER) AS frequency_end, CAST(NULL AS VARCHAR) AS error
FROM predicted JOIN grid USING (band_id) GROUP BY ALL"""
    )


WIDTHS = [2, 5]
TWO_CHANNELS = [(b, 0, lo, hi) for b, lo, hi in grid.bands(widths=WIDTHS)]
query("sweep_two_channels", grid_sql(32, [(0, 1)], TWO_CHANNELS, lambda i, w: f"{int(w)}Hz width 2 channels"))(
    lambda spark, sf: swept(spark, sf, "csp", WIDTHS, 2)
)

# Four channels, and two configurations with channels of their own.
NAMES = ["c0", "c1", "c2", "c3"]
CONFIGURATIONS = [(["c2", "c0"], 2), (["c1", "c3"], 5)]
LIST_BANDS = sweep.grid_bands(CONFIGURATIONS)


def swept_lists(spark, sf):
    """Both channel lists out of one filtering and one Gram matrix per epoch."""
    epochs = views.epochs(spark, sf, 4).withColumn("recording_id", F.concat(F.lit("rec"), (F.col("epoch_id") % 5).cast("string")))
    blocks = epochs.withColumn("channels", grid.literals(NAMES))
    scores = sweep.score_blocks(blocks, LIST_BANDS, "csp", rate=RATE)
    return sweep.result_rows(scores, sweep.grid_cells(spark, LIST_BANDS), "csp")


query(
    "sweep_channel_lists",
    grid_sql(
        16,
        [(2, 0), (1, 3)],
        [(b, [names for names, _ in CONFIGURATIONS].index(list(own)), lo, hi) for b, lo, hi, own in LIST_BANDS],
        lambda i, w: f"{int(w)}Hz width 2 channels",
    ),
)(swept_lists)

# One classifier on two bands: the strongest filter of each.
SET_CELLS = [(0, 0, 8.0, 12.0), (1, 0, 14.0, 20.0), (2, 0, 22.0, 26.0)]
SETS = {0: [0, 1], 1: [2, 0]}


def swept_sets(spark, sf):
    epochs = views.epochs(spark, sf, 2).withColumn("recording_id", F.concat(F.lit("rec"), (F.col("epoch_id") % 5).cast("string")))
    bands = [(b, lo, hi) for b, _, lo, hi in SET_CELLS]
    scores = sweep.score_blocks(epochs, bands, "csp", rate=RATE, sets=SETS, n_components=1)
    return scores.select("recording_id", F.col("band_id").alias("set_id"), "split_id", "accuracy")


query(
    "sweep_band_sets",
    with_ctes(
        *sweep_ctes(32, [(0, 1)], SET_CELLS),
        "powers_of_sets AS (SELECT p.*, set_id, place FROM powers p JOIN (VALUES "
        + ", ".join(f"({k}, {b}, {at})" for k, own in SETS.items() for at, b in enumerate(own))
        + ") v(set_id, band_id, place) USING (band_id) WHERE component = 0)",
        *[
            cte.replace("FROM powers ", "FROM powers_of_sets ")
            for cte in rated_ctes("recording_id, set_id, split_id", "max(f) FILTER (place = 0) AS f0, max(f) FILTER (place = 1) AS f1")
        ],
    )
    + f"SELECT recording_id, set_id, split_id, {ACCURACY} FROM predicted GROUP BY ALL",
)(swept_sets)

query("sweep_results")(lambda spark, sf: swept(spark, sf, "csp", [1, 2, 3, 4, 5, 6, 7]))
query("sweep_results_tensor")(lambda spark, sf: swept(spark, sf, "parafac", [1, 2, 3, 4, 5, 6, 7]))


def two_stages(spark, sf, window=None):
    return staged.two_stage_scores(
        recordings(spark, sf).withColumn("class_id", (F.col("epoch_id") % 3).cast("int")),
        [(0, 8.0, 12.0)],
        window,
        rate=RATE,
    )


query("two_stage_scores")(two_stages)
query("two_stage_window_scores")(lambda spark, sf: two_stages(spark, sf, (4, 2)))
query("running_scores")(
    lambda spark, sf: running.running_scores(
        recordings(spark, sf), [(0, 8.0, 12.0), (1, 14.0, 20.0)], rate=RATE, length=4, step=2
    )
)
