"""Registered queries: splits, covariances, filters, tensors, discriminants."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wavemill.operators import evaluate, linear, spatial, tensor
from wavemill.operators import splits as sp
from wavemill.plans.sqltext import with_ctes
from wavemill.registry import query
from wavemill.sources import views
from wavemill.sources.tables import table

SPLITS_SQL = """splits AS (
  SELECT 'rec0' AS recording_id, CAST(split_id AS INTEGER) AS split_id, epoch_id,
         CASE WHEN row_number() OVER (PARTITION BY split_id
                ORDER BY md5('42:' || split_id || ':' || epoch_id), epoch_id)
              <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY split_id))
              THEN 'test' ELSE 'train' END AS role
  FROM (SELECT vec_id AS epoch_id, s AS split_id FROM embeddings, range(0, 10) r(s)))"""

PER_SPLIT = ["recording_id", "split_id"]


def splits(spark, sf):
    return sp.shuffle_split(views.epochs(spark, sf))


query("shuffle_split", with_ctes(SPLITS_SQL) + "SELECT * FROM splits")(splits)


def cells(df, column: str, width: int, names=("i", "j"), value="value", digits: int = 9):
    """Flat matrix column as (row, column, value) rows."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("_p", "_v")).select(
        *rest,
        F.floor(F.col("_p") / width).cast("int").alias(names[0]),
        (F.col("_p") % width).cast("int").alias(names[1]),
        (F.round("_v", digits) + 0.0).alias(value),
    )


query(
    "epoch_gram",
    with_ctes(views.epochs_sql())
    + """SELECT a.epoch_id, a.channel AS i, b.channel AS j, round(sum(a.value * b.value), 9) + 0.0 AS value
FROM tensor a JOIN tensor b ON b.epoch_id = a.epoch_id AND b.t = a.t GROUP BY ALL""",
)(
    lambda spark, sf: cells(
        spatial.epoch_gram(views.epochs(spark, sf)).select("epoch_id", "data"), "data", 8
    )
)


def covariances(spark, sf, channels=views.TENSOR_CHANNELS):
    grams = spatial.epoch_gram(views.epochs(spark, sf, channels))
    return spatial.class_covariance(grams, splits(spark, sf), sp.N_SPLITS)


def covariance_sql(times: int) -> str:
    return f"""cov AS (
  SELECT split_id, a.class_id, a.channel AS i, b.channel AS j,
         sum(a.value * b.value) / (count(DISTINCT a.epoch_id) * {times}) AS value
  FROM tensor a JOIN tensor b ON b.epoch_id = a.epoch_id AND b.t = a.t
  JOIN splits s ON s.epoch_id = a.epoch_id AND s.role = 'train'
  GROUP BY ALL)"""


query(
    "class_covariance",
    with_ctes(views.epochs_sql(), SPLITS_SQL, covariance_sql(8))
    + "SELECT split_id, class_id, i, j, round(value, 9) + 0.0 AS value FROM cov",
)(
    lambda spark, sf: cells(covariances(spark, sf).select("split_id", "class_id", "cov"), "cov", 8)
)

# Two channels of 32 times: the filters have a closed form.
def two_channel_sql(keys: str) -> str:
    return f"""m AS (
  SELECT {keys},
    max(value) FILTER (class_id = 0 AND i = 0 AND j = 0) AS a11,
    max(value) FILTER (class_id = 0 AND i = 0 AND j = 1) AS a12,
    max(value) FILTER (class_id = 0 AND i = 1 AND j = 1) AS a22,
    sum(value) FILTER (i = 0 AND j = 0) AS s11,
    sum(value) FILTER (i = 0 AND j = 1) AS s12,
    sum(value) FILTER (i = 1 AND j = 1) AS s22
  FROM cov GROUP BY {keys}),
q AS (
  SELECT *, s11 * s22 - s12 * s12 AS a, a11 * s22 + a22 * s11 - 2 * a12 * s12 AS b,
         a11 * a22 - a12 * a12 AS c FROM m),
roots AS (
  SELECT *, (b + sign * sqrt(b * b - 4 * a * c)) / (2 * a) AS share
  FROM q, (VALUES (1), (-1)) v(sign)),
raw AS (SELECT *, a12 - share * s12 AS v0, share * s11 - a11 AS v1 FROM roots),
scaled AS (
  SELECT *, v0 / sqrt(v0 * v0 * s11 + 2 * v0 * v1 * s12 + v1 * v1 * s22) AS u0,
         v1 / sqrt(v0 * v0 * s11 + 2 * v0 * v1 * s12 + v1 * v1 * s22) AS u1 FROM raw),
filters AS (
  SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY abs(share - 0.5) DESC) - 1
                        AS INTEGER) AS component, share,
         u0 * sign(CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) AS w0,
         u1 * sign(CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) AS w1
  FROM scaled)"""


def two_channel_filters(spark, sf):
    return spatial.csp_filters(covariances(spark, sf, 2))


query(
    "csp_filters",
    with_ctes(views.epochs_sql(32), SPLITS_SQL, covariance_sql(32), two_channel_sql("split_id"))
    + """SELECT split_id, component, round(share, 6) AS share, round(w0, 5) AS w0, round(w1, 5) AS w1
FROM filters""",
)(
    lambda spark, sf: two_channel_filters(spark, sf)
    .select("split_id", "filters", F.posexplode("shares").alias("component", "share"))
    .select(
        "split_id",
        "component",
        F.round("share", 6).alias("share"),
        F.round(F.get("filters", F.col("component") * 2), 5).alias("w0"),
        F.round(F.get("filters", F.col("component") * 2 + 1), 5).alias("w1"),
    )
)

query("csp_filters_all_channels")(
    lambda spark, sf: spatial.csp_filters(covariances(spark, sf)).select(
        "split_id", F.posexplode("shares").alias("component", "share")
    )
)

# --- features with fixed filters -------------------------------------------

# Two fixed filters over the eight channels: their mean, and their alternating sum.
ROOT = 1 / math.sqrt(8)
FIXED = [[ROOT] * 8, [ROOT if c % 2 == 0 else -ROOT for c in range(8)]]
WEIGHTS_SQL = """weights AS (
  SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS channel,
         (CASE WHEN k = 1 AND c % 2 = 1 THEN -1 ELSE 1 END) / sqrt(8) AS w
  FROM range(0, 2) a(k), range(0, 8) b(c))"""
FEATURES_SQL = """projected AS (
  SELECT epoch_id, class_id, k, t, sum(w * value) AS p
  FROM tensor JOIN weights USING (channel) GROUP BY ALL),
features AS (
  SELECT epoch_id, class_id, max(f) FILTER (k = 0) AS f0, max(f) FILTER (k = 1) AS f1
  FROM (SELECT epoch_id, class_id, k, ln(sum(p * p) / count(*)) AS f FROM projected GROUP BY ALL)
  GROUP BY ALL)"""
FEATURE_CTES = [views.epochs_sql(), WEIGHTS_SQL, FEATURES_SQL]


def fixed_filters(spark):
    flat = [v for row in FIXED for v in row]
    return spark.createDataFrame([("rec0", flat)], "recording_id string, filters array<double>")


def features(spark, sf):
    grams = spatial.epoch_gram(views.epochs(spark, sf))
    return spatial.csp_log_power(grams, fixed_filters(spark), ["recording_id"])


def with_roles(df, spark, sf):
    return df.join(splits(spark, sf), ["recording_id", "epoch_id"])


def part(df, role):
    return df.filter(F.col("role") == role)


query(
    "csp_log_power",
    with_ctes(*FEATURE_CTES)
    + "SELECT epoch_id, class_id, round(f0, 6) + 0.0 AS f0, round(f1, 6) + 0.0 AS f1 FROM features",
)(
    lambda spark, sf: features(spark, sf).select(
        "epoch_id",
        "class_id",
        *[(F.round(F.get("features", F.lit(i)), 6) + 0.0).alias(f"f{i}") for i in range(2)],
    )
)

query(
    "concat_features",
    with_ctes(*FEATURE_CTES)
    + """SELECT epoch_id, CAST(p AS INTEGER) AS position, round(CASE p WHEN 0 THEN f0 WHEN 1 THEN f1
  WHEN 2 THEN f0 + 1 ELSE f1 + 1 END, 6) + 0.0 AS value FROM features, range(0, 4) r(p)""",
)(
    lambda spark, sf: spatial.concat_features(
        features(spark, sf)
        .withColumn("band_id", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("features", F.transform("features", lambda v: v + F.col("band_id"))),
        ["epoch_id"],
    )
    .select("epoch_id", F.posexplode("features").alias("position", "value"))
    .withColumn("value", F.round("value", 6) + 0.0)
)

STATS_SQL = """stats AS (
  SELECT split_id, class_id, count(*) AS n, sum(f0) AS s0, sum(f1) AS s1, sum(f0 * f0) AS q00,
         sum(f0 * f1) AS q01, sum(f1 * f1) AS q11
  FROM features JOIN splits USING (epoch_id) WHERE role = 'train' GROUP BY ALL)"""


def statistics(spark, sf):
    return linear.lda_statistics(part(with_roles(features(spark, sf), spark, sf), "train"), PER_SPLIT)


query(
    "lda_statistics",
    with_ctes(*FEATURE_CTES, SPLITS_SQL, STATS_SQL)
    + """SELECT split_id, class_id, n, round(s0, 6) AS s0, round(s1, 6) AS s1, round(q00, 6) AS q00,
  round(q01, 6) AS q01, round(q11, 6) AS q11 FROM stats""",
)(
    lambda spark, sf: statistics(spark, sf).select(
        "split_id",
        "class_id",
        "n",
        *[F.round(F.get("sums", F.lit(i)), 6).alias(f"s{i}") for i in range(2)],
        *[
            F.round(F.get("squares", F.lit(i)), 6).alias(n)
            for i, n in ((0, "q00"), (1, "q01"), (3, "q11"))
        ],
    )
)

def discriminant_sql(keys: str) -> str:
    """Linear scores of two features from ``stats``, in closed form."""
    return f"""within AS (
  SELECT {keys}, sum(n) AS n, (sum(q00) - sum(s0 * s0 / n)) / (sum(n) - 2) AS c00,
         (sum(q01) - sum(s0 * s1 / n)) / (sum(n) - 2) AS c01,
         (sum(q11) - sum(s1 * s1 / n)) / (sum(n) - 2) AS c11
  FROM stats GROUP BY {keys}),
model AS (
  SELECT {keys}, s.class_id, ln(s.n / w.n) AS prior, s0 / s.n AS m0, s1 / s.n AS m1,
         c11 / (c00 * c11 - c01 * c01) AS i00, -c01 / (c00 * c11 - c01 * c01) AS i01,
         c00 / (c00 * c11 - c01 * c01) AS i11
  FROM stats s JOIN within w USING ({keys})),
lines AS (
  SELECT {keys}, class_id, i00 * m0 + i01 * m1 AS b0, i01 * m0 + i11 * m1 AS b1,
         prior - 0.5 * (m0 * (i00 * m0 + i01 * m1) + m1 * (i01 * m0 + i11 * m1)) AS b
  FROM model)"""


MODEL_SQL = (
    discriminant_sql("split_id")
    + """,
predicted AS (
  SELECT split_id, epoch_id, f.class_id AS actual, arg_max(l.class_id, b0 * f0 + b1 * f1 + b) AS predicted
  FROM features f JOIN splits s USING (epoch_id) JOIN lines l USING (split_id)
  WHERE role = 'test' GROUP BY split_id, epoch_id, f.class_id)"""
)


def predictions(spark, sf):
    models = linear.lda_fit(statistics(spark, sf), PER_SPLIT)
    test = part(with_roles(features(spark, sf), spark, sf), "test")
    return linear.linear_score(test, models, PER_SPLIT).withColumnRenamed("class_id", "actual")


query(
    "lda_predict",
    with_ctes(*FEATURE_CTES, SPLITS_SQL, STATS_SQL, MODEL_SQL)
    + "SELECT split_id, epoch_id, actual, predicted FROM predicted",
)(
    lambda spark, sf: predictions(spark, sf).select("split_id", "epoch_id", "actual", "predicted")
)

query(
    "split_accuracy",
    with_ctes(*FEATURE_CTES, SPLITS_SQL, STATS_SQL, MODEL_SQL)
    + """SELECT split_id, count(*) FILTER (predicted = actual) AS hits, count(*) AS cases,
  count(*) FILTER (predicted = actual)::DOUBLE / count(*) AS accuracy FROM predicted GROUP BY ALL""",
)(lambda spark, sf: evaluate.accuracy_per_split(predictions(spark, sf)))

# Fixed weights: class 1 where the second log power exceeds the first.
FIXED_MODEL = [(0, [1.0, 0.0], 0.0), (1, [0.0, 1.0], 0.125)]


def fixed_model(spark):
    return spark.createDataFrame(
        [("rec0", FIXED_MODEL)],
        "recording_id string, classes array<struct<class_id:int, coef:array<double>, intercept:double>>",
    )


query(
    "linear_score",
    with_ctes(*FEATURE_CTES)
    + """SELECT epoch_id, CAST(CASE WHEN f1 + 0.125 > f0 THEN 1 ELSE 0 END AS INTEGER) AS predicted,
  round(greatest(f0, f1 + 0.125), 6) + 0.0 AS score FROM features""",
)(
    lambda spark, sf: linear.linear_score(
        features(spark, sf), fixed_model(spark), ["recording_id"]
    ).select("epoch_id", "predicted", (F.round("score", 6) + 0.0).alias("score"))
)

query(
    "window_accuracy",
    with_ctes(
        views.epochs_sql(),
        WEIGHTS_SQL,
        SPLITS_SQL,
        """projected AS (
  SELECT epoch_id, class_id, k, t, sum(w * value) AS p FROM tensor JOIN weights USING (channel)
  GROUP BY ALL),
windowed AS (
  SELECT epoch_id, class_id, CAST(v AS INTEGER) AS window_id,
         ln(sum(p * p) FILTER (k = 0) / 4) AS f0, ln(sum(p * p) FILTER (k = 1) / 4) AS f1
  FROM projected JOIN range(0, 2) r(v) ON t >= 2 * v AND t < 2 * v + 4
  GROUP BY ALL)""",
    )
    + """SELECT split_id, window_id, count(*) FILTER ((f1 + 0.125 > f0) = (class_id = 1)) AS hits,
  count(*) AS cases,
  count(*) FILTER ((f1 + 0.125 > f0) = (class_id = 1))::DOUBLE / count(*) AS accuracy
FROM windowed JOIN splits USING (epoch_id) WHERE role = 'test' GROUP BY ALL""",
)(
    lambda spark, sf: evaluate.accuracy_per_split(
        linear.linear_score(
            spatial.csp_log_power(
                spatial.window_gram(views.epochs(spark, sf), 4, 2),
                fixed_filters(spark),
                ["recording_id"],
            ).join(part(splits(spark, sf), "test"), ["recording_id", "epoch_id"]),
            fixed_model(spark),
            ["recording_id"],
        ).withColumnRenamed("class_id", "actual"),
        ["split_id", "window_id"],
    )
)

# --- truncated SVD ---------------------------------------------------------

GRAM_SQL = """grams AS (
  SELECT split_id, count(*) AS n, sum(f0 * f0) AS g00, sum(f0 * f1) AS g01, sum(f1 * f1) AS g11
  FROM features JOIN splits USING (epoch_id) WHERE role = 'train' GROUP BY ALL)"""


def train_gram(spark, sf):
    return linear.feature_gram(part(with_roles(features(spark, sf), spark, sf), "train"), PER_SPLIT)


query(
    "feature_gram",
    with_ctes(*FEATURE_CTES, SPLITS_SQL, GRAM_SQL)
    + """SELECT split_id, n, round(g00, 6) AS g00, round(g01, 6) AS g01, round(g11, 6) AS g11 FROM grams""",
)(
    lambda spark, sf: train_gram(spark, sf).select(
        "split_id",
        "n",
        *[
            F.round(F.get("gram", F.lit(i)), 6).alias(n)
            for i, n in ((0, "g00"), (1, "g01"), (3, "g11"))
        ],
    )
)

query(
    "svd_project",
    with_ctes(
        *FEATURE_CTES,
        SPLITS_SQL,
        GRAM_SQL,
        """roots AS (
  SELECT *, (g00 + g11) / 2 + s * sqrt(((g00 - g11) / 2) ** 2 + g01 * g01) AS lam, s
  FROM grams, (VALUES (1), (-1)) v(s)),
raw AS (SELECT *, g01 AS v0, lam - g00 AS v1 FROM roots),
vectors AS (
  SELECT split_id, s, v0 / sqrt(v0 * v0 + v1 * v1) * sign(CASE WHEN abs(v0) >= abs(v1) THEN v0 ELSE v1 END) AS u0,
         v1 / sqrt(v0 * v0 + v1 * v1) * sign(CASE WHEN abs(v0) >= abs(v1) THEN v0 ELSE v1 END) AS u1
  FROM raw)""",
    )
    + """SELECT split_id, epoch_id, role,
  round(max(f0 * u0 + f1 * u1) FILTER (s = 1), 6) + 0.0 AS z0,
  round(max(f0 * u0 + f1 * u1) FILTER (s = -1), 6) + 0.0 AS z1
FROM features JOIN splits USING (epoch_id) JOIN vectors USING (split_id) GROUP BY ALL""",
)(
    lambda spark, sf: linear.svd_project(
        with_roles(features(spark, sf), spark, sf),
        linear.svd_basis(train_gram(spark, sf), PER_SPLIT, 2),
        PER_SPLIT,
    ).select(
        "split_id",
        "epoch_id",
        "role",
        *[(F.round(F.get("features", F.lit(i)), 6) + 0.0).alias(f"z{i}") for i in range(2)],
    )
)

# --- tensor decomposition --------------------------------------------------

query(
    "cp_mttkrp",
    with_ctes(views.epochs_sql())
    + """SELECT channel, CAST(r AS INTEGER) AS r, round(sum(value * cos(epoch_id * (r + 1)) * sin(t + r)), 9) AS m
FROM tensor, range(0, 3) x(r) GROUP BY ALL""",
)(
    lambda spark, sf: tensor.cp_mttkrp(
        views.epoch_samples(spark, sf),
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("epoch_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
        .withColumn("a", F.cos(F.col("epoch_id") * (F.col("r") + 1))),
        spark.range(8)
        .select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("r"))
        .withColumn("f", F.sin(F.col("t") + F.col("r"))),
    ).withColumn("m", F.round("m", 9))
)


def reconstructed(spark, sf, **options):
    epochs = views.epochs(spark, sf)
    factors = tensor.cp_factors(
        tensor.tensor_gram(epochs, ["recording_id"]), ["recording_id"], **options
    )
    return tensor.cp_reconstruct(epochs, factors, ["recording_id"])


query("cp_reconstruct")(
    lambda spark, sf: cells(reconstructed(spark, sf).select("epoch_id", "data"), "data", 8, ("channel", "t"))
)

# One sweep from factors of ones, rank one: every update is a plain aggregate.
query(
    "cp_rank_one",
    with_ctes(
        views.epochs_sql(),
        "a AS (SELECT epoch_id, sum(value) / 64 AS a FROM tensor GROUP BY ALL)",
        "aa AS (SELECT sum(a * a) AS aa FROM a)",
        """b AS (SELECT channel, sum(value * a) / (8 * any_value(aa)) AS b
  FROM tensor JOIN a USING (epoch_id), aa GROUP BY channel)""",
        "bb AS (SELECT sum(b * b) AS bb FROM b)",
        """f AS (SELECT t, sum(value * a * b) / (any_value(aa) * any_value(bb)) AS f
  FROM tensor JOIN a USING (epoch_id) JOIN b USING (channel), aa, bb GROUP BY t)""",
    )
    + """SELECT epoch_id, channel, t, round(a * b * f, 9) + 0.0 AS value
FROM tensor JOIN a USING (epoch_id) JOIN b USING (channel) JOIN f USING (t)""",
)(
    lambda spark, sf: cells(
        reconstructed(spark, sf, rank=1, sweeps=1, start=1.0).select("epoch_id", "data"),
        "data",
        8,
        ("channel", "t"),
    )
)

# --- two stages ------------------------------------------------------------

query(
    "two_stage_decision",
    """WITH p AS (SELECT doc_id AS epoch_id, quality AS first, 1 + toxic AS second FROM labels)
SELECT epoch_id, CAST(CASE WHEN first = 0 THEN 0 ELSE second END AS INTEGER) AS predicted FROM p""",
)(
    lambda spark, sf: evaluate.two_stage_decision(
        table(spark, sf, "labels").select(
            F.col("doc_id").alias("epoch_id"), F.col("quality").alias("predicted")
        ),
        table(spark, sf, "labels").select(
            F.col("doc_id").alias("epoch_id"), (F.col("toxic") + 1).alias("predicted")
        ),
        ["epoch_id"],
    ).withColumn("predicted", F.col("predicted").cast("int"))
)

query(
    "two_stage_membership",
    """SELECT o_orderkey AS epoch_id, CAST(CASE WHEN o_custkey % 3 = 2 THEN 1 ELSE o_custkey % 3 END AS INTEGER) AS stage1,
  CAST(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 END AS INTEGER) AS stage2,
  CASE WHEN o_custkey % 3 <> 0 THEN 'both' ELSE 'first' END AS stages FROM orders""",
)(
    lambda spark, sf: evaluate.two_stage_membership(
        table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("epoch_id"), (F.col("o_custkey") % 3).cast("int").alias("class_id")
        )
    )
)
