"""Ordered per-key operators whose task size does not depend on the key size.

A plain window puts a whole key into one task.  Here rows first get their
position inside the key; every later ordered step works on fixed-length blocks of
positions, and only one row per block travels to join the blocks up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numbers in one bucket of an integer order column.
NUMBERS = 100_000
# Positions per block.
BLOCK = 500_000


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join that keeps the key columns of the left side."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def coarse(df: DataFrame, column: str) -> Column:
    """A bucket that keeps the order of a column: an hour, a run of numbers, the first two letters.

    NaN comes last, as it does in Spark's order.  Types without a bucket are an error.
    """
    kind = df.schema[column].dataType.simpleString()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.date_trunc("hour", F.col(column))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.floor(F.col(column) / NUMBERS)
    if kind in ("float", "double"):
        whole = F.floor(F.greatest(F.least(F.col(column), F.lit(9e18)), F.lit(-9e18)))
        return F.when(F.isnan(column), F.lit(2**63 - 1)).when(F.col(column).isNotNull(), whole)
    if kind.startswith("decimal"):
        return F.floor(F.col(column)).cast("decimal(38,0)")
    if kind == "string":
        return F.substring(column, 1, 2)
    raise TypeError(f"rows cannot be numbered by {column}, which is {kind}")


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], out: str = "row_idx", bucket: Column | None = None
) -> DataFrame:
    """0-based position of each row inside its key, by ascending ``order`` columns (NULL first).

    Rows are ranked inside buckets of the first order column, and a bucket's first position is the
    sum of the rows in earlier ones, so a hot key is as many tasks as it has buckets.  ``bucket``
    replaces the usual one; it must not fall where the first order column rises.
    """
    bucketed = df.withColumn("_bucket", coarse(df, order[0]) if bucket is None else bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        join_on(bucketed.withColumn("_at", F.row_number().over(inside)), first, [*keys, "_bucket"])
        .withColumn(out, (F.col("_first") + F.col("_at") - 1).cast("long"))
        .drop("_bucket", "_first", "_at")
    )


def previous_value(
    df: DataFrame, keys: list[str], idx: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Value of the row before, by position; the last row of a block is also
    sent to the next block, so that each block is complete in itself."""
    home = F.floor(F.col(idx) / block)
    targets = F.when(F.col(idx) % block == block - 1, F.array(home, home + 1)).otherwise(
        F.array(home)
    )
    w = Window.partitionBy(*keys, "_block").orderBy(idx)
    return (
        df.withColumn("_block", F.explode(targets))
        .withColumn(out, F.lag(value).over(w))
        .filter(F.col("_block") == F.floor(F.col(idx) / block))
        .drop("_block")
    )


def total_before(
    df: DataFrame, keys: list[str], idx: str, value: str, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (0 for the first)."""
    blocks = df.withColumn("_block", F.floor(F.col(idx) / block))
    earlier = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocks.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_t"))
        .select(*keys, "_block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        join_on(blocks, offsets, [*keys, "_block"])
        .withColumn(out, F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_off")
    )


def top_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per key.  Spark keeps at most k rows per key and map task
    (WindowGroupLimit) before the shuffle, so a hot key arrives already reduced."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
