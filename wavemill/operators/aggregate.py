"""Aggregates given by the caller, in two phases.

A caller's function over a whole group would hold that group in one task.  Here it is three functions on Arrow tables: tasks
turn rows into partial states, states of a key are merged, and a last step makes the row.  Only states travel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.apply import arrow_schema

#: Rows that a task sums up at a time, and states of a key that are merged at a time.
ROWS = 100_000
STATES = 1_000


@dataclass(frozen=True)
class Aggregate:
    """``partial``: the rows of one key -> a state (a table with the columns of ``state``); ``merge``: states -> a state;
    ``finish``: a state -> one row with the columns of ``result``.  The order of rows and states must not matter."""

    state: str
    result: str
    partial: Callable[[pa.Table], pa.Table]
    merge: Callable[[pa.Table], pa.Table]
    finish: Callable[[pa.Table], pa.Table]


def aggregate(df: DataFrame, keys: list[str], how: Aggregate) -> DataFrame:
    """One row of ``how.result`` for each key; NULL keys are a key."""
    types = dict(df.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    state, result = f"{named}, _part bigint, {how.state}", f"{named}, {how.result}"
    target = arrow_schema(state)

    def with_key(table: pa.Table, values: list, part: int | None) -> pa.Table:
        columns = [pa.array([v] * table.num_rows, target.field(i).type) for i, v in enumerate(values)]
        names = list(keys)
        if part is not None:
            columns.append(pa.array([part] * table.num_rows, pa.int64()))
            names.append("_part")
        return pa.Table.from_arrays([*columns, *table.columns], names=[*names, *table.column_names])

    def by_key(table: pa.Table):
        """(values, rows) of each key of a table."""
        order = table.sort_by([(k, "ascending") for k in keys])
        runs = order.select(keys).to_pylist()
        cuts = [i for i in range(len(runs)) if i == 0 or runs[i] != runs[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(runs)]):
            yield list(runs[a].values()), order.slice(a, b - a).drop_columns(keys)

    def partials(batches):
        held, size = [], 0

        def flush():
            for at, (values, rows) in enumerate(by_key(pa.Table.from_batches(held))):
                yield from with_key(how.partial(rows), values, hash((at, size)) & 0xFFFF).cast(target).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        values = [table.column(k)[0].as_py() for k in keys]
        return with_key(how.merge(table.drop_columns([*keys, "_part"])), values, 0).cast(target)

    def finish(table: pa.Table) -> pa.Table:
        values = [table.column(k)[0].as_py() for k in keys]
        return with_key(how.finish(how.merge(table.drop_columns([*keys, "_part"]))), values, None)

    states = df.mapInArrow(partials, state)
    # States of a key meet in bounded numbers first, however many tasks there were.
    some = states.groupBy(*keys, F.pmod(F.xxhash64("_part"), F.lit(STATES)).alias("_slot")).applyInArrow(merge, state)
    return some.groupBy(*keys).applyInArrow(finish, result)


def mean_of_largest(column: str, k: int, out: str) -> Aggregate:
    """Mean of the k largest values; NaN and NULL take no part, and a key without values has NULL."""

    def largest(values) -> pa.Table:
        import numpy as np

        own = values.combine_chunks().drop_null().to_numpy()
        own = own[~np.isnan(own)]
        return pa.table({"_best": pa.array([np.sort(own)[-k:]], pa.list_(pa.float64()))})

    def finish(state: pa.Table) -> pa.Table:
        own = state.column("_best")[0].values
        return pa.table({out: pa.array([own.to_numpy().mean() if len(own) else None], pa.float64())})

    return Aggregate(
        "_best array<double>",
        f"{out} double",
        lambda rows: largest(rows.column(column)),
        lambda states: largest(pa.chunked_array([states.column("_best").combine_chunks().flatten()])),
        finish,
    )
