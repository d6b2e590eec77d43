"""Running streams to the end of what is available, and their sinks."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from wavemill.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """Unused folder for the output and state of one run, on shared storage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def append_parquet(stream: DataFrame, out: str, partition_by: list[str] = []) -> None:
    """Append-mode file sink; the sink's log makes restarts exactly-once."""
    (
        stream.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("checkpointLocation", f"{out}/_state")
        .trigger(availableNow=True)
        .start(f"{out}/data")
        .awaitTermination()
    )


def each_batch(stream: DataFrame, out: str, mode: str = "update") -> None:
    """Write every micro-batch to its own folder; a repeated batch replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{out}/_state")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


class Watch(StreamingQueryListener):
    """Tells when a query has gone far enough by its progress, or has ended."""

    def __init__(self, enough, until_idle: bool):
        self.enough, self.until_idle, self.done, self.run_id = enough, until_idle, threading.Event(), None

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if str(event.progress.runId) == self.run_id and self.enough(event.progress):
            self.done.set()

    def onQueryIdle(self, event):
        if self.until_idle and str(event.runId) == self.run_id:
            self.done.set()

    def onQueryTerminated(self, event):
        if str(event.runId) == self.run_id:
            self.done.set()


def run_until(stream: DataFrame, out: str, enough, write=None, mode: str = "append", until_idle: bool = False) -> None:
    """Run a stream until ``enough(progress)`` says so, or with ``until_idle`` nothing more has come, and then stop it.

    Progress comes by micro-batch, so what follows in the batches begun is written too: leave it out in the plan
    if it must not be.  ``write(batch, batch_id)`` takes the batches, as Parquet by batch without it.
    """

    def to_parquet(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    spark = stream.sparkSession
    watch = Watch(enough, until_idle)
    spark.streams.addListener(watch)
    try:
        writer = stream.writeStream.foreachBatch(write or to_parquet).outputMode(mode)
        run = writer.option("checkpointLocation", f"{out}/_state").start()
        watch.run_id = str(run.runId)
        if run.recentProgress and any(map(enough, run.recentProgress)):  # before the id was known
            watch.done.set()
        if not run.isActive:
            watch.done.set()
        watch.done.wait()
        run.stop()
        if run.exception():
            raise run.exception()
    finally:
        spark.streams.removeListener(watch)


def run_while(stream: DataFrame, more, out: str) -> None:
    """Hand each micro-batch to ``more(batch, batch_id)`` and stop once it returns False."""
    over = threading.Event()

    def step(batch: DataFrame, batch_id: int) -> None:
        if not over.is_set() and not more(batch, batch_id):
            over.set()

    run_until(stream, out, lambda progress: over.is_set(), step)


def result(spark: SparkSession, out: str, schema) -> DataFrame:
    """Rows a stream has written, without the folder column of :func:`each_batch`."""
    df = spark.read.schema(schema).parquet(f"{out}/data")
    return df.drop("batch")
