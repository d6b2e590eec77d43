"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges.

Records are ordered by (hash of the text, doc_id), so equal texts lie side by side.  A sample in
which a record's chance grows with its size gives boundaries at quantiles of the bytes; rows
go to the range between two boundaries of the text hash, so equal texts share a range.  The exact
bytes of all ranges are then summed.  A range that is overfull, for instance because one text
has thousands of copies, is sampled again and subdivided by (hash, doc_id) until none is left
that could be.  Consecutive ranges fill the shards up to equal shares of all bytes.

Only a bounded number of ranges, and sampled keys, ever reaches the driver; rows are numbered
inside their range and a range's first slot follows from the counts of those before it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.shared import kept

#: Ranges per shard, and how often each range is sampled on average.
RANGES, SAMPLES = 64, 24
#: A range above this share of a shard is subdivided.
OVERFULL = 1 / 32
#: Rows of a range at most, on average; more rows mean more ranges.
ROWS_PER_RANGE = 500_000
ROUNDS = 4


def quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    """Distinct boundaries that cut a sorted sample into about equal parts."""
    keys = sorted(keys)
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)} - {keys[0]}) if keys else []


def places(h: np.ndarray, d: np.ndarray, cut: list[tuple]) -> np.ndarray:
    """Number of boundaries (hash, doc_id) at or below each key."""
    ch, cd = np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64)
    low, high = np.searchsorted(ch, h, "left"), np.searchsorted(ch, h, "right")
    out = low.copy()
    for at in np.unique(low[high > low]).tolist():
        own = (low == at) & (high > low)
        stop = int(high[own][0])
        out[own] = at + np.searchsorted(cd[at:stop], d[own], "right")
    return out


def _number(cut: list[tuple]):
    @F.pandas_udf("long")
    def number(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(places(h.to_numpy(), d.to_numpy(), cut))

    return number


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) for every row.

    The law is ``bytes``: a row weighs the UTF-8 bytes of its text (null: none) plus one.  Equal
    texts share a shard unless they alone overfill a range.  A null doc_id sorts first, rows that
    are equal in all columns keep slots of their own, an empty table gives no row, other columns are
    left out.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
    )
    rows = kept(rows.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63)))), "shard-keys")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = shards * max(RANGES, -(-count // (shards * ROWS_PER_RANGE)))
    limit = max(1, int(total / shards * OVERFULL))

    def sample(of: DataFrame, bytes_: int, want: int) -> list[tuple]:
        chance = F.col("size") * F.lit(want / max(1, bytes_))
        drawn = F.pmod(F.xxhash64("d", "h", F.lit(3)), F.lit(1 << 30)) < chance * F.lit(float(1 << 30))
        return [(r["h"], r["d"]) for r in of.where(drawn).select("h", "d").collect()]  # about ``want`` keys

    # Boundaries of the text hash alone first; then pairs inside overfull ranges.
    cut = [(h, -(1 << 63)) for h in sorted({h for h, _ in quantiles(sample(rows, total, ranges * SAMPLES), ranges)})]
    for _ in range(ROUNDS):
        numbered = rows.withColumn("range", _number(cut)("h", "d")) if cut else rows.withColumn("range", F.lit(0).cast("long"))
        sizes = numbered.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(F.struct("h", "d")).alias("low"), F.max(F.struct("h", "d")).alias("high"))
        table = sorted(sizes.collect(), key=lambda r: r["range"])  # a bounded number of ranges
        over = [r for r in table if r["size"] > limit and r["low"] != r["high"]]
        if not over:
            break
        amount = sum(r["size"] for r in over)
        parts = {r["range"]: -(-2 * r["size"] // limit) for r in over}
        hot = numbered.where(F.col("range").isin([r["range"] for r in over]))
        drawn: dict[int, list] = {}
        keys = sample(hot, amount, SAMPLES * sum(parts.values()))
        own = places(np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), cut)
        for key, r in zip(keys, own.tolist()):
            drawn.setdefault(r, []).append(key)
        new = set()
        for r in over:
            new |= set(quantiles(drawn.get(r["range"], []), parts[r["range"]])) - {tuple(r["low"])}
        if not new - set(cut):
            break
        cut = sorted(set(cut) | new)

    numbered = rows.withColumn("range", _number(cut)("h", "d")) if cut else rows.withColumn("range", F.lit(0).cast("long"))
    table = sorted(numbered.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect(), key=lambda r: r["range"])
    before, slots, plan = 0, [0] * shards, []
    for r in table:
        shard = min(shards - 1, (2 * before + r["size"]) * shards // (2 * total))
        plan.append((r["range"], shard, slots[shard]))
        before += r["size"]
        slots[shard] += r["rows"]
    planned = docs.sparkSession.createDataFrame(plan, "range long, shard int, first long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "d", "text_crc32")) - 1
    return (
        numbered.withColumn("inside", inside)
        .join(F.broadcast(planned), "range")  # one row a range
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 16) -> None:
    """Write whole records, each shard a folder ``shard=k`` of Parquet files in slot order."""
    placed = assign(docs, shards).select("doc_id", "text_crc32", "shard", "slot").distinct()
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_crc", F.crc32(raw))
    # Rows equal in id and checksum share a place; any of their slots keeps the order.
    first = placed.groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("_place"))
    first = first.select(F.col("doc_id").alias("_i"), F.col("text_crc32").alias("_c"), "_place")
    joined = keyed.join(first, keyed["_id"].eqNullSafe(first["_i"]) & (keyed["_crc"] == first["_c"]))
    out = joined.withColumn("shard", F.col("_place.shard")).repartitionByRange("shard", "_place").sortWithinPartitions("shard", "_place")
    out.drop("_id", "_crc", "_i", "_c", "_place").write.partitionBy("shard").parquet(folder)
