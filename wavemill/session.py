"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "wavemill") -> SparkSession:
    """A session for tests and single-node benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder: on a cluster that would not be shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="wavemill-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so that lost executors do no harm."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores ahead of a step that costs far more than its input bytes.

    Adaptive execution merges partitions by size, which would leave such a step to a
    few tasks; an explicit partition count is left alone.
    """
    spark = df.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(shuffles, spark.sparkContext.defaultParallelism), *keys)
