"""Stateful command streams: change detection and busy suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["key", "t", "event_id", "command", "playing_us"]
OUTPUT = "key bigint, t bigint, event_id bigint, command string, playing_us bigint"
STATE = "keys array<bigint>, busy array<bigint>, last array<string>"
#: Groups of keys: a call for each key would cost far more than its rows.
BUCKETS = 256


def plain_rows(commands: DataFrame) -> DataFrame:
    """Time in microseconds, so that workers compare integers."""
    return commands.select(
        "key",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        "event_id",
        "command",
        F.rint(F.col("playing_s") * 1e6).cast("long").alias("playing_us"),
    )


def pass_changes(rows, busy, last, started):
    """Rows whose command differs from the one before; NULL equals NULL, a first row always counts."""
    keep = []
    for _, command, _ in rows:
        keep.append(command != last or not started)
        last, started = command, True
    return keep, busy, last


def pass_playable(rows, busy, last, started):
    """Rows that start to play: nothing is playing, and the command is not the last played."""
    keep = []
    for t, command, length in rows:
        play = (busy is None or t >= busy) and command != last
        if play:
            busy, last = int(t + length), command
        keep.append(play)
    return keep, busy, last


def as_python(column: pd.Series, order: np.ndarray) -> list:
    """Values in an order; NaN, which stands for NULL in some frames, as None."""
    return [None if v != v else v for v in column.to_numpy()[order].tolist()]


def stateful(commands: DataFrame, rule) -> DataFrame:
    """Apply a rule in time order per key, carrying (busy until, last command).

    Keys are hashed into ``BUCKETS`` groups whose state lists them; rows without key are a group, so that a column of keys
    is never of floats.  A call sees a group's rows of one micro-batch; the source's trigger bound limits how many that can be.
    """

    def step(group, frames, state: GroupState):
        held = {k: (busy, last) for k, busy, last in zip(*state.get)} if state.exists else {}
        pdf = pd.concat(list(frames), ignore_index=True)
        order = np.lexsort([pdf[c].to_numpy() for c in ("event_id", "t", "key")])
        keys, *columns = (as_python(pdf[c], order) for c in ("key", "t", "command", "playing_us"))
        rows = list(zip(*columns))
        keep = []
        begin = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[begin]:
                key = keys[begin]
                busy, last = held.get(key, (None, None))
                own, *after = rule(rows[begin:end], busy, last, key in held)
                held[key] = tuple(after)
                keep.extend(own)
                begin = end
        state.update((list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
        yield pdf.take(order[np.array(keep, bool)])[COLUMNS]

    bucket = F.when(F.col("key").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return (
        plain_rows(commands)
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def stream_change_only(commands: DataFrame) -> DataFrame:
    return stateful(commands, pass_changes)


def stream_throttle(commands: DataFrame) -> DataFrame:
    return stateful(commands, pass_playable)
