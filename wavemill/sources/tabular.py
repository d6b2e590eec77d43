"""CSV source and sink of result and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators.ordered import number_rows

RESULTS_SCHEMA = (
    "participant string, task string, date string, classifier string, accuracy double, "
    "frequency double, configuration string, frequency_start int, frequency_end int"
)
# Result rows as the bulk job keeps them.
STORED_SCHEMA = f"{RESULTS_SCHEMA}, recording_id string, split_id int, error string"


def read_csv(spark: SparkSession, path: str, schema: str, with_index: bool = True) -> DataFrame:
    """CSV with a header and a fixed schema; a leading unnamed index column is dropped."""
    full = f"_index bigint, {schema}" if with_index else schema
    df = spark.read.schema(full).option("header", True).option("enforceSchema", True).csv(path)
    return df.drop("_index")


def write_csv(df: DataFrame, path: str, index_order: list[str] | None = None) -> None:
    """CSV with a header.  ``index_order`` adds a running index as an unnamed first column."""
    if index_order:
        one = number_rows(df.withColumn("_all", F.lit(1)), ["_all"], index_order, "_row")
        df = one.select(F.col("_row").alias(" "), *df.columns).orderBy(" ")
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Result rows as Parquet, one folder per participant; folders of participants that occur are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("participant").parquet(path)
