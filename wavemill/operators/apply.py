"""Applying per-key models (small arrays) to many rows in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows of one key that share a task-side group.
GROUP = 2_048


def with_model(
    rows: DataFrame, models: DataFrame, keys: list[str], run, schema: str, size: int = GROUP
) -> DataFrame:
    """``run(rows, models) -> table`` on bounded groups of rows together with their key's models.

    A join would repeat the model arrays on every row.  Here rows of a key are hashed into
    buckets of about ``size`` rows, and each bucket gets its models once; a hot key becomes
    many buckets.
    """
    buckets = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_buckets"))
    spot = F.pmod(F.xxhash64("epoch_id"), F.col("_buckets")).cast("int")
    left = rows.join(buckets, keys).withColumn("_bucket", spot).drop("_buckets")
    right = (
        models.join(buckets, keys)
        .withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)))
        .drop("_buckets")
    )

    def step(row_table: pa.Table, model_table: pa.Table) -> pa.Table:
        if not row_table.num_rows or not model_table.num_rows:
            return empty
        return run(row_table.drop_columns(["_bucket"]), model_table)

    empty = arrow_schema(schema).empty_table()
    group = [*keys, "_bucket"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(step, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """List column of equal lengths as rows of a matrix."""
    lists = table.column(column).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def one_width(table: pa.Table, column: str):
    """Pieces of a table whose list column has one length."""
    lists = table.column(column).combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    for width in np.unique(counts):
        yield table.take(pa.array(np.flatnonzero(counts == width)))
