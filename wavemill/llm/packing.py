"""Mixture-controlled packing by deficit round-robin over one queue per source.

A window is a fixed run of sequences.  Each window owes a source its target share of the
window's tokens.  Served in whole tokens, the debt is carried on, so after any number of
windows a source is off its share by less than one token plus half a token per source.  With the sources' own
shares as targets all queues run dry together and every window but the last is full.

The state of the round-robin after m windows has a closed form: token j of a source with T
tokens falls due at (2j + 1) / 2T, and after m windows the first m * window tokens by due time
(ties: by source) are served.  So a task starts at any window with the right deficits, and
nothing is played from the beginning.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm import tokens
from wavemill.llm.shared import kept
from wavemill.llm.words import pieces

SEQUENCE = 2048
#: Sequences in a window, the unit in which target proportions hold.
WINDOW_SEQUENCES = 16
#: Queue slots of a source; a slot is summed up before places in the queue are given.
ROWS_PER_SLOT = 2_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Schedule:
    """What each source has been served after m windows."""

    def __init__(self, totals: list[int], window: int):
        self.totals, self.window, self.all = totals, window, sum(totals)

    def due(self, t: int) -> list[int]:
        """Tokens of each source that fall due before t / (2 * all), for an integer t."""
        # (2j + 1) / 2T < t / 2A, so j < (t * T / A - 1) / 2
        return [max(0, min(n, -((self.all - t * n) // (2 * self.all)))) for n in self.totals]

    def served(self, m: int) -> list[int]:
        """Tokens of each source in the first m windows; they add up to m windows or to all."""
        want = min(m * self.window, self.all)
        if not want:
            return [0] * len(self.totals)
        # Rounding moves each source by half a token at most, so the time is 2 * want or close to it.
        reach = 2 * len(self.totals) + 2
        low, high = max(0, 2 * want - reach), min(2 * self.all + 1, 2 * want + reach)
        while high - low > 1:
            middle = (low + high) // 2
            if sum(self.due(middle)) <= want:
                low = middle
            else:
                high = middle
        got, more = self.due(low), self.due(high)
        short = want - sum(got)
        for s in range(len(got)):
            step = min(short, more[s] - got[s])
            got[s] += step
            short -= step
        return got


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, row (a number of its own), n (ids) and ids of every document, written once."""

    def run(batches):
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        narrow = max(end_id, encoder.library.get_vocab_size()) < 1 << 16
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = [x + end for x in encoder.encode(part.column("text").to_pylist())]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if narrow:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), rows, n, pa.array(ids, pa.binary())],
                    ["doc_id", "source", "row", "n", "ids"],
                )

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text")
    return kept(wide.mapInArrow(run, "doc_id long, source string, row long, n long, ids binary"), "ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES) -> DataFrame:
    """Pieces of all documents in full sequences; only the very last one can be short.

    Null texts count as empty (their piece is the end id), a null or missing source is a source
    named "", repeated rows are documents of their own, an empty table gives no piece, other
    columns are left out.  The number of sources is taken to be small enough for a list.
    """
    coded = encode_documents(docs, tokenizer, end_id)
    spark = docs.sparkSession
    sources = {r["source"]: (r["t"], r["rows"]) for r in coded.groupBy("source").agg(F.sum("n").alias("t"), F.count("*").alias("rows")).collect()}
    names = sorted(sources)
    schedule = Schedule([int(sources[s][0]) for s in names], sequence * window_sequences)
    slots = 1 + sum(r for _, r in sources.values()) // ROWS_PER_SLOT
    # Queue order: slot by hash, then row.  Slots are summed first, so no window holds a whole source.
    narrow = coded.select("source", "row", "n").withColumn("slot", F.pmod(F.xxhash64("row"), F.lit(slots)))
    by_slot = narrow.groupBy("source", "slot").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = by_slot.select("source", "slot", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slot").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    places = narrow.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(by_slot, ["source", "slot"])
    places = places.select("row", (F.col("base") + F.col("inside")).alias("place"))

    def run(batches):
        number = {s: k for k, s in enumerate(names)}
        served: dict[int, list[int]] = {}

        def at(m):
            if m not in served:
                if len(served) > 100_000:
                    served.clear()
                served[m] = schedule.served(m)
            return served[m]

        window, total = schedule.window, schedule.all
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "source", "n", "place", "ids")]
            for doc_id, source, n, place, raw in zip(*cols):
                s = number[source]
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                # The window of the first token, estimated from its due time and then stepped to.
                m = (2 * place + 1) * total // (2 * schedule.totals[s]) // window
                while m > 0 and at(m)[s] > place:
                    m -= 1
                while at(m + 1)[s] <= place:
                    m += 1
                done = 0
                while done < n:
                    first, last = at(m), at(m + 1)
                    begin = m * window + sum(last[:s]) - sum(first[:s]) + place + done - first[s]
                    stop = min(n, done + last[s] - (place + done))
                    while done < stop:
                        length = min(stop - done, sequence - begin % sequence)
                        crc = zlib.crc32(ids[done : done + length].tobytes())
                        out.append((doc_id, done, length, crc, n, begin // sequence, begin % sequence, source))
                        done += length
                        begin += length
                    m += 1
            for a in range(0, len(out), 20_000):
                cols = list(zip(*out[a : a + 20_000]))
                arrays = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    if not names:
        return spark.createDataFrame([], PIECES)
    return coded.join(places, "row").mapInArrow(run, PIECES)
