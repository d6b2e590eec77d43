"""Token files: independent zstandard frames, a document index and a trailing seek table.

A file is a run of independent zstandard frames, each with the ids of some whole documents;
then one skippable frame with the document index (zstandard: doc ids, whether they are null,
id counts, frame of each document); then, as in zstandard's seekable format, one skippable
frame with the seek table: for each frame its compressed size, size and checksum, closed by the
number of frames, a flag byte and a magic number.  A reader takes the tail, then only the
frames that hold the documents it wants; zstandard tools can decompress the whole file.
Ids are stored as little-endian 16-bit numbers where the vocabulary allows, else 32-bit.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm import tokens
from wavemill.llm.words import pieces

#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Magic number of the skippable frame with the document index.
INDEX_MAGIC = 0x184D2A50
#: Bytes of ids after which a frame ends; a longer document has a frame of its own.
FRAME_BYTES = 256 << 10

MANIFEST = "part int, file string, n_docs long, n_tokens long, width int"


class Writer:
    """One file; memory is one frame plus 25 bytes a document."""

    def __init__(self, sink, width: int, level: int = 3):
        self.sink, self.kind = sink, np.dtype(f"<u{width}")
        self.zip = zstandard.ZstdCompressor(level=level)
        self.buffer, self.size, self.table = [], 0, []
        self.ids, self.counts, self.frame, self.n_tokens = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.kind).tobytes()
        if self.size and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        self.buffer.append(raw)
        self.size += len(raw)
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.frame.append(len(self.table))
        self.n_tokens += len(ids)

    def flush(self) -> None:
        raw = b"".join(self.buffer)
        packed = self.zip.compress(raw)
        self.sink.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.buffer, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        ids = np.array([i or 0 for i in self.ids], "<i8")
        null = np.array([i is None for i in self.ids], "u1")
        index = b"".join(
            x.tobytes() for x in (ids, np.array(self.counts, "<u8"), np.array(self.frame, "<u8"), null)
        )
        body = struct.pack("<QB", len(ids), self.kind.itemsize) + self.zip.compress(index)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        entries = b"".join(struct.pack("<III", *row) for row in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot)


class Reader:
    """Reads the tail once, then decompresses only frames that are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        begin = size - 9 - 12 * n - 8
        table = np.frombuffer(self.at(begin + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table.T if n else np.zeros((3, 0), np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.packed)])
        body = self.at(int(self.begin[-1]) + 8, begin - int(self.begin[-1]) - 8)
        docs, width = struct.unpack_from("<QB", body)
        raw = zstandard.ZstdDecompressor().decompress(body[9:])
        self.ids = np.frombuffer(raw, "<i8", docs)
        self.counts = np.frombuffer(raw, "<u8", docs, 8 * docs).astype(np.int64)
        self.frame = np.frombuffer(raw, "<u8", docs, 16 * docs).astype(np.int64)
        self.null = np.frombuffer(raw, "u1", docs, 24 * docs).astype(bool)
        self.kind = np.dtype(f"<u{width}")
        self.start = np.cumsum(self.counts) - self.counts

    def at(self, begin: int, n: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(n)

    def frame_ids(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self.at(int(self.begin[k]), int(self.packed[k])))
        if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, self.kind)

    def documents(self, wanted: np.ndarray | None = None):
        """(doc id, ids before it in the file, its ids) of all or of the wanted documents."""
        take = np.arange(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, wanted) & ~self.null)
        held, ids, base = -1, None, 0
        for d in take.tolist():
            if self.frame[d] != held:
                held = int(self.frame[d])
                ids, base = self.frame_ids(held), int(self.start[np.searchsorted(self.frame, held)])
            at = int(self.start[d]) - base
            yield None if self.null[d] else int(self.ids[d]), int(self.start[d]), ids[at : at + int(self.counts[d])]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of all documents in ascending doc_id order, one file a range of ids.

    Null texts count as empty, null ids come first, repeated rows stay (ordered by text);
    other columns are not read.  A task writes to a name of its own and then reports it, so files
    of tasks that were lost or ran twice are never listed in ``folder/manifest``.
    """

    def run(batches):
        encoder = tokens.encoder(tokenizer)
        width = 2 if max(end_id, encoder.library.get_vocab_size()) < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        writer = None
        for batch in batches:
            for part in pieces(batch, "text"):
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    if writer is None:
                        store, path = fs.FileSystem.from_uri(folder)
                        store.create_dir(path, recursive=True)
                        name = f"ids-{uuid.uuid4().hex}.zst"
                        sink = store.open_output_stream(f"{path}/{name}", compression=None)
                        writer = Writer(sink, width)
                    writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            from pyspark import TaskContext

            row = [[TaskContext.get().partitionId()], [name], [len(writer.ids)], [writer.n_tokens], [width]]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)], ["part", "file", "n_docs", "n_tokens", "width"]
            )

    spark = docs.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = docs.select("doc_id", "text").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, ids before it over all files, id count and crc32 of its ids, read from the files.

    ``wanted`` is a short list of ids; other frames are then not decompressed.  The manifest has
    one row a file.
    """
    from pyspark.sql import Window

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("before", before).select("file", "before")
    keep = None if wanted is None else np.array(sorted(set(wanted)), np.int64)
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType()))]
    )

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                store, path = fs.FileSystem.from_uri(f"{folder}/{file}")
                with store.open_input_file(path) as source:
                    rows = [
                        (d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for d, s, ids in Reader(source, source.size()).documents(keep)
                    ]
                for a in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema.names)

    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(count, "file").mapInArrow(run, schema)
