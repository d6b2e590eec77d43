"""External counting of token pairs: sorted runs, k-way merges, counts streamed back to documents.

A record is (code, document, n): a pair of ids that a document links n times, with the major side's id in the upper bits of its
code.  Tasks cut their records into runs of bounded length, split each run by a radix of the major id, sort it, and
write it in zstandard blocks; beside each run goes its sum by code.  The sums are merged, up to FAN_IN runs at a time, until one
run a radix is left.  It is in the order of the major id, so that the highest count of each one is known as soon as
its codes have passed.  Then the blocks of records meet the counts of their radix, and what each document gets streams back.

Nothing here grows with a hot pair: a run has one sum for it, and its records are dealt block by block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import words
from wavemill.llm.shared import kept

#: Bits of a code that hold the minor id.
MINOR = 16
RADIXES = 16
#: Records of a run and of a block, runs of a merge, and blocks of records that one task streams.
RUN = 2 << 20
BLOCK = 1 << 16
FAN_IN = 64
STREAM = 32

BLOCKS = "kind int, radix int, run long, first long, blob binary"


def radix_of(code: np.ndarray) -> np.ndarray:
    return (words.mix((code >> MINOR).astype(np.uint64), 31) % np.uint64(RADIXES)).astype(np.int64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length in a zstandard frame; the first one ascends and goes as differences."""
    parts = [np.diff(columns[0], prepend=0), *columns[1:]]
    raw = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in parts)
    return zstandard.ZstdCompressor(level=1, write_checksum=True).compress(raw)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    parts = [np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel() for x in np.split(raw, columns)]
    return [np.cumsum(parts[0]), *parts[1:]]


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by code of ascending codes."""
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


class Runs:
    """Records of one task; ``name`` tells its runs from those of other tasks."""

    def __init__(self, name: int):
        self.name, self.turn, self.held, self.size = name << 24, 0, [], 0

    def add(self, code: np.ndarray, document: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        self.held.append((code, document, n))
        self.size += len(code)
        if self.size >= RUN:
            yield from self.spill()

    def spill(self) -> Iterator[tuple]:
        """Blocks (kind, radix, run, first, blob): 1 records, 2 sums."""
        if not self.size:
            return
        code, document, n = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        radix = radix_of(code)
        order = np.argsort(radix << 48 | code, kind="stable")  # documents ascend within a code
        code, document, n, radix = code[order], document[order], n[order], radix[order]
        edges = np.searchsorted(radix, np.arange(RADIXES + 1))
        for r, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            for at in range(a, b, BLOCK):
                end = min(b, at + BLOCK)
                yield 1, r, self.name + self.turn, int(code[at]), packed(code[at:end], document[at:end], n[at:end])
            yield from sums(r, self.name + self.turn, *summed(code[a:b], n[a:b]))
        self.turn += 1


def sums(radix: int, run: int, code: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    for at in range(0, len(code), BLOCK):
        yield 2, radix, run, int(code[at]), packed(code[at : at + BLOCK], n[at : at + BLOCK])


class Merge:
    """k-way merge of sum blocks that arrive by ascending first code."""

    def __init__(self):
        self.heap: list[tuple] = []  # (next code, order of arrival, codes, sums)
        self.arrived = 0

    def push(self, code: np.ndarray, n: np.ndarray) -> None:
        heapq.heappush(self.heap, (int(code[0]), self.arrived, code, n))
        self.arrived += 1

    def below(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """All sums of codes under the limit; what is left of a block goes back on the heap."""
        codes, counts = [], []
        while self.heap and self.heap[0][0] < limit:
            _, order, code, n = heapq.heappop(self.heap)
            at = int(np.searchsorted(code, limit))
            codes.append(code[:at])
            counts.append(n[:at])
            if at < len(code):
                heapq.heappush(self.heap, (int(code[at]), order, code[at:], n[at:]))
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, n = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        return summed(code[order], n[order])

    def settle(self) -> None:
        """Combine what has piled up, so that memory follows the distinct codes and not the runs."""
        if len(self.heap) > 8:
            code, n = self.below(1 << 62)
            if len(code):
                self.push(code, n)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, radix, run, first, blob = zip(*rows)
    cols = [pa.array(kind, pa.int32()), pa.array(radix, pa.int32()), pa.array(run, pa.int64()), pa.array(first, pa.int64()), pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["kind", "radix", "run", "first", "blob"])


def merged(blocks: DataFrame, last: bool) -> DataFrame:
    """One run for each (radix, run) of sum blocks; in the last merge counts with their marks of being the highest (kind 3)."""

    def out(radix, run, code, n):
        if not last:
            return list(sums(radix, run, code, n))
        major = code >> MINOR
        begin = np.flatnonzero(np.append(True, major[1:] != major[:-1])[: len(major)])
        high = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(n)))) if len(n) else n
        rows = []
        for at in range(0, len(code), BLOCK):
            end = at + BLOCK
            rows.append((3, radix, run, int(code[at]), packed(code[at:end], n[at:end], (n == high)[at:end].astype(np.int64))))
        return rows

    def run(batches):
        place, merge, held = None, Merge(), 0
        for rows in batches:
            names = zip(rows.column("radix").to_pylist(), rows.column("run").to_pylist())
            for k, (own, first) in enumerate(zip(names, rows.column("first").to_pylist())):
                if own != place:
                    if place is not None and (got := out(*place, *merge.below(1 << 62))):
                        yield batch(got)
                    place, merge, held = own, Merge(), 0
                if held >= 8 * BLOCK:  # whole majors only: the highest count needs all codes of its major
                    if got := out(*place, *merge.below(first >> MINOR << MINOR)):
                        yield batch(got)
                    merge.settle()
                    held = 0
                merge.push(*unpacked(rows.column("blob")[k].as_py(), 2))
                held += BLOCK
        if place is not None and (got := out(*place, *merge.below(1 << 62))):
            yield batch(got)

    shuffles = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(shuffles, "radix", "run").sortWithinPartitions("radix", "run", "first")
    return dealt.mapInArrow(run, BLOCKS)


def counts(blocks: DataFrame) -> DataFrame:
    """Blocks of kind 3, in order of their codes in each radix: codes, corpus-wide counts, and 1 where a count is its major id's highest."""
    left = blocks.where("kind = 2").select("kind", "radix", "run", "first", "blob")
    while True:
        runs = left.select("run").distinct().count()
        fan = max(1, math.ceil(runs / FAN_IN))
        left = left.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(fan)))
        left = kept(merged(left, fan == 1), "merged")
        if fan == 1:
            return left


def contributions(blocks: DataFrame, counted: DataFrame) -> DataFrame:
    """(document, n_best, count_sum): links whose count is the highest of their major id, and counts summed over links."""
    records = blocks.where("kind = 1").select("radix", "run", "first", "blob")
    parts = records.groupBy("radix").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("parts"))  # RADIXES rows
    part = F.pmod(F.xxhash64("run", "first"), F.col("parts")).cast("int").alias("part")
    own = records.join(F.broadcast(parts), "radix").select("radix", part, F.lit(1).alias("kind"), "first", "blob")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    known = counted.join(F.broadcast(parts), "radix").select("radix", every, F.lit(0).alias("kind"), "first", "blob")
    shuffles = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.union(known).repartition(shuffles, "radix", "part").sortWithinPartitions("radix", "part", "kind", "first")

    def run(batches):
        place, table, total = None, [], None
        for rows in batches:
            names = zip(rows.column("radix").to_pylist(), rows.column("part").to_pylist())
            for k, (own, kind) in enumerate(zip(names, rows.column("kind").to_pylist())):
                if own != place:
                    place, table, total = own, [], None
                blob = rows.column("blob")[k].as_py()
                if kind == 0:
                    table.append(unpacked(blob, 3))
                    continue
                total = total or [np.concatenate(x) for x in zip(*table)]
                code, document, n = unpacked(blob, 3)
                at = np.searchsorted(total[0], code)
                if not np.array_equal(total[0][at], code):
                    raise ValueError("a pair came without its count")
                order = np.argsort(document, kind="stable")
                document, n, at = document[order], n[order], at[order]
                first = np.flatnonzero(np.append(True, document[1:] != document[:-1])[: len(document)])
                cols = [document[first], np.add.reduceat(n * total[2][at], first), np.add.reduceat(n * total[1][at], first)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["document", "n_best", "count_sum"])

    streamed = dealt.mapInArrow(run, "document long, n_best long, count_sum long")
    return streamed.groupBy("document").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
