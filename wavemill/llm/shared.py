"""Small helpers of the operators here: folders all executors see, Arrow output, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.session import shared_dir

#: Whether the shuffle files of an execution go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that Python gets at once.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Links whose components one task finds at a time.
LINKS = 1 << 18


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder the cluster shares."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, batch: int | None = None, group: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, columns stay prunable.

    Nothing reads the shuffles of the write again, so their files go at its end and not when the driver happens to collect its garbage.
    With ``batch``, Python functions get about so many bytes of rows at once; with ``group``, Spark later reads at most so many rows at once.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key) for key in wanted}
    writer = df.write.option("compression", "zstd")
    if group:
        writer = writer.option("parquet.block.row.count.limit", group)
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        writer.parquet(folder)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(folder)


def lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists from values end to end and the position where each list begins."""
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(values, kind))


def one_by_one(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to any number of batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and the smallest node that these links reach from each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        left = root[x] != root[y]
        x, y = x[left], y[left]
    return nodes, nodes[root]


def forest(links: DataFrame) -> DataFrame:
    """(node, component) of up to ``LINKS`` links (a, b) of a task at a time; the same nodes are linked through these rows."""
    most = LINKS

    def found(held):
        table = pa.Table.from_batches(held)
        node, root = smallest(*(table.column(c).to_numpy() for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "component"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if rows + part.num_rows > most:
                    yield found(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield found(held)

    return links.where("a <> b").select("a", "b").mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); linked nodes only.

    Each task first finds the components of its own links, and up to ``LINKS`` of what is left are put together by one task.
    More go by large-star and small-star rounds: each node's neighbours move to the smallest one seen, which
    halves paths, so the number of rounds grows with the logarithm of the longest path.  Per
    node only a minimum is kept, combined before the shuffle, so hubs cost no memory.
    """
    own = kept(forest(links), "links")
    edges = own.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if edges.count() <= LINKS:
        return kept(forest(edges.coalesce(1)), "components")

    def smallest_first(e):
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = smallest_first(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = kept(smallest_first(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
