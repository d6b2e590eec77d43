"""Busy suppression: a command starts only if nothing is playing and it is not a repeat.

Which command starts next depends only on the one that started last, so a key is a
chain through its rows.  A key is cut into blocks of rows.  What a block does is a short table
"entered in this state, left in that state", because chains that enter it at different rows soon run into
each other.  Two tables in a row make one table again, so blocks are put together ``FAN`` at a time into a tree, the state before
each node is pushed down from the root, and then all blocks are played at once, each from its own entry state.
No task holds more than ``FAN`` tables or one block, and keys of a single block need no table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.ordered import number_rows

#: Rows of a block, tables put together at a time, and levels of the tree above the blocks: FAN ** LEVELS blocks have one root.
BLOCK = 20_000
FAN = 64
LEVELS = 2

#: One row per node; runs of entry times with one outcome.  A missing busy time means that the state passes through.
TABLE = (
    "until array<bigint>, split array<boolean>, command array<string>, free_busy array<bigint>, free_last array<string>, "
    "repeat_busy array<bigint>, repeat_last array<string>"
)


class Chain:
    """Successor links of one block: rows in time order."""

    def __init__(self, pdf: pd.DataFrame):
        self.t = pdf["t"].to_numpy()
        self.busy = self.t + pdf["playing_us"].to_numpy()
        self.command = pdf["command"].to_numpy()
        n = len(self.t)
        turns = np.flatnonzero(self.command[1:] != self.command[:-1]) + 1
        at = np.searchsorted(turns, np.arange(n), side="right")
        # Next row with another command, n if there is none.
        self.other = np.append(turns, n)[at]

    def enter(self, busy, last) -> int:
        """First row that can start in this state."""
        i = 0 if busy is None else int(np.searchsorted(self.t, busy, side="left"))
        if i < len(self.t) and self.command[i] == last:
            i = int(self.other[i])
        return i

    def after(self, i: int) -> int:
        # A zero playing time must not let a row follow itself.
        j = max(i + 1, int(np.searchsorted(self.t, self.busy[i], side="left")))
        if j < len(self.t) and self.command[j] == self.command[i]:
            j = int(self.other[j])
        return j

    def played(self, busy, last) -> list[int]:
        out, i = [], self.enter(busy, last)
        while i < len(self.t):
            out.append(i)
            i = self.after(i)
        return out

    def exits(self) -> list[int]:
        """Last row started in the block by the chain through each row."""
        n = len(self.t)
        out = [0] * n
        for i in range(n - 1, -1, -1):
            j = self.after(i)
            out[i] = out[j] if j < n else i
        return out

    def table(self) -> list[tuple]:
        """Runs of entry rows with one outcome: (latest t, outcomes differ, command, state if free, state if repeat).

        An outcome of None means that nothing starts and the state passes through.
        """
        ends = [None if e < 0 else (int(self.busy[e]), self.command[e]) for e in (*self.exits(), -1)]
        return joined((int(t), self.command[i], ends[i], ends[int(self.other[i])]) for i, t in enumerate(self.t))


def joined(runs) -> list[tuple]:
    """(t, command, free, repeat) with neighbours of one outcome put together."""
    out: list[tuple] = []
    for t, command, free, repeat in runs:
        what = (free != repeat, command if free != repeat else None, free, repeat)
        if out and out[-1][1:] == what:
            out.pop()
        out.append((t, *what))
    return out


def leave(table: list[tuple], busy, last):
    """State after a table that is entered in a state."""
    at = 0 if busy is None else int(np.searchsorted([r[0] for r in table], busy, side="left"))
    if at == len(table):
        return busy, last
    _, split, command, free, repeat = table[at]
    out = repeat if split and command == last else free
    return (busy, last) if out is None else out


def compose(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """The table of two tables in a row.

    A state that passes through the first one repeats its command there and is free before the second one begins.
    """

    def on(state, command):
        if state is not None:
            return leave(second, *state)
        _, split, other, free, repeat = second[0]
        return repeat if split and other == command else free

    mapped = [(t, command, on(free, command), on(repeat, command) if split else on(free, command)) for t, split, command, free, repeat in first]
    return joined([*mapped, *((t, command, free, repeat) for t, _, command, free, repeat in second)])


def to_columns(table: list[tuple]) -> dict:
    until, split, command, free, repeat = zip(*table)
    parts = [[None if s is None else s[i] for s in side] for side in (free, repeat) for i in (0, 1)]
    return dict(zip((c.split()[0] for c in TABLE.split(", ")), (list(until), list(split), list(command), *parts)))


def from_columns(row) -> list[tuple]:
    def states(busy, last):
        return [None if pd.isna(b) else (int(b), c) for b, c in zip(busy, last)]

    return list(zip((int(t) for t in row.until), map(bool, row.split), row.command, states(row.free_busy, row.free_last), states(row.repeat_busy, row.repeat_last)))


def throttle(commands: DataFrame, block: int = BLOCK) -> DataFrame:
    """Commands that get played, from (key, ts, event_id, command, playing_s) rows.

    A first command that is NULL counts as a repeat.  Rows of a key come in the order of (ts, event_id).
    """
    rows = commands.select(
        "key",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        "event_id",
        "command",
        F.rint(F.col("playing_s") * 1e6).cast("long").alias("playing_us"),
    )
    hours = F.floor(F.col("t") / 3_600_000_000)
    rows = number_rows(rows, ["key"], ["t", "event_id"], "_idx", hours).withColumn("node", F.floor(F.col("_idx") / block))
    long_keys = rows.filter("node > 0").select(F.col("key").alias("_key")).distinct()
    tables = summaries(rows.join(long_keys, F.col("key").eqNullSafe(F.col("_key")), "left_semi"))
    return played(rows.withColumn("begins", F.col("_idx") % block == 0), entries(tables))


def summaries(rows: DataFrame) -> DataFrame:
    """(key, node, table) of every block."""
    schema = f"key {dict(rows.dtypes)['key']}, node bigint, {TABLE}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = Chain(pdf.sort_values("_idx")).table()
        return pd.DataFrame([{"key": pdf["key"].iloc[0], "node": pdf["node"].iloc[0], **to_columns(table)}])

    return rows.groupBy("key", "node").applyInPandas(run, schema)


def entries(tables: DataFrame) -> DataFrame:
    """(key, node, busy, last): the state in which each block is entered."""
    schema = f"key {dict(tables.dtypes)['key']}, node bigint"
    above = F.floor(F.col("node") / FAN).alias("above")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [from_columns(r) for r in pdf.sort_values("node").itertuples()]
        table = own.pop()
        while own:
            table = compose(own.pop(), table)
        return pd.DataFrame([{"key": pdf["key"].iloc[0], "node": pdf["above"].iloc[0], **to_columns(table)}])

    def follow(pdf: pd.DataFrame, busy, last) -> pd.DataFrame:
        out = []
        for row in pdf.sort_values("node").itertuples():
            out.append((row.key, row.node, busy, last))
            busy, last = leave(from_columns(row), busy, last)
        return pd.DataFrame(out, columns=["key", "node", "busy", "last"]).astype({"busy": "Int64"})

    def down(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        busy = entry["busy"].iloc[0]
        return follow(pdf, None if pd.isna(busy) else int(busy), entry["last"].iloc[0])

    levels = [tables.select("*", above)]
    for _ in range(LEVELS):
        up = levels[-1].groupBy("key", "above").applyInPandas(together, f"{schema}, {TABLE}")
        levels.append(up.select("*", above))
    state = f"{schema}, busy bigint, last string"
    out = levels[-1].groupBy("key").applyInPandas(lambda pdf: follow(pdf, None, None), state)
    for level in reversed(levels[:-1]):
        entry = out.withColumnRenamed("node", "above")
        out = level.groupBy("key", "above").cogroup(entry.groupBy("key", "above")).applyInPandas(down, state)
    return out


def played(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Rows that start, each block read in order from its entry state."""
    columns = ["key", "t", "event_id", "command", "playing_us"]
    known = states.withColumnsRenamed({"key": "_key", "node": "_node"})
    both = rows.join(known, F.col("key").eqNullSafe(F.col("_key")) & (F.col("node") == F.col("_node")), "left")
    both = both.select(*columns, "_idx", "node", "begins", "busy", "last")

    def scan(batches):
        busy, last = None, None
        for pdf in batches:
            keep = []
            for begins, t, c, d, b, s in zip(*(pdf[x] for x in ("begins", "t", "command", "playing_us", "busy", "last"))):
                if begins:
                    busy, last = (None if pd.isna(b) else int(b)), s
                play = (busy is None or t >= busy) and c != last
                if play:
                    busy, last = t + d, c
                keep.append(play)
            yield pdf.loc[keep, columns]

    dealt = both.repartition("key", "node").sortWithinPartitions("key", "node", "_idx")
    out = dealt.mapInPandas(scan, rows.select(*columns).schema)
    return out.select("key", "event_id", "command", (F.col("playing_us") / 1e6).alias("playing_s"))
