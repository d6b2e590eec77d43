"""EDF+ recordings as a data source: chunked samples and annotations.

``spark.read.format("edf").load(folder)`` reads every regular file of a folder whose name ends exactly in ``.edf``.
Planning lists names and lengths only; files are cut into ranges of bytes, short ones share a range, and a task reads the data
records that begin in its own.  How many records a file has follows from its length; the header's count may be missing
(-1) or out of date.  The options ``kind``, ``channels``, ``first`` and ``last`` leave out what they rule out before it is decoded.
(Filters are not taken over by the reader: Spark keeps one reader for all scans of a loaded frame, so that the
filters of one would hold for all.)
``spark.readStream.format("edf")`` follows growing recordings: its offset is the length of each file, and
whole records beyond the last one are read once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

# EDF+ layout - field widths of the file header and of a signal header.
FILE_FIELDS = [
    ("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8),
    ("header_bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4),
]
SIGNAL_FIELDS = [
    ("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8),
    ("dig_min", 8), ("dig_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32),
]
ANNOTATIONS = "EDF Annotations"

CHUNK = 4096
SPLIT_BYTES = 64 << 20
# Opening a file costs as much as reading so many bytes, so that many short files make many ranges.
OPEN_BYTES = 1 << 20
# Bytes of records that a task reads at a time.
READ_BYTES = 8 << 20

SCHEMA = (
    "path string, kind string, channel string, unit string, rate double, start_idx bigint, "
    "values array<double>, onset_s double, duration_s double, label string"
)


def header_bytes(head: bytes) -> int:
    return int(head[184:192])


def parse_header(head: bytes) -> dict:
    """Header of a file as numbers; signals as lists."""
    out, at = {}, 0
    for name, width in FILE_FIELDS:
        out[name] = head[at : at + width].decode("latin-1").strip()
        at += width
    n = int(out["signals"])
    for name, width in SIGNAL_FIELDS:
        out[f"s_{name}"] = [
            head[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)
        ]
        at += n * width
    out["s_samples"] = [int(v) for v in out["s_samples"]]
    out["records"], out["duration"] = int(out["records"]), float(out["duration"])
    out["header_bytes"] = int(out["header_bytes"])
    return out


def parse_annotations(raw: bytes):
    """(onset, duration, text) of the annotation lists in one record; time marks have no text."""
    for tal in raw.split(b"\x00"):
        if not tal:
            continue
        stamp, *texts = tal.split(b"\x14")
        onset, _, duration = stamp.partition(b"\x15")
        for text in texts:
            if text:
                yield float(onset), float(duration or 0), text.decode("utf-8")


def with_text(part: np.ndarray) -> np.ndarray:
    """The records whose annotation lists have a text, which most do not: 0x14 and then neither 0x14 nor 0."""
    raw = np.ascontiguousarray(part).view(np.uint8)
    return part[((raw[:, :-1] == 0x14) & (raw[:, 1:] != 0x14) & (raw[:, 1:] != 0)).any(axis=1)]


@dataclass(frozen=True)
class Wanted:
    """What is asked for: a kind, channels (None: all), and the first and last start_idx."""

    kind: str | None = None
    channels: frozenset | None = None
    first: int | None = None
    last: int | None = None

    def annotations(self) -> bool:
        return self.kind in (None, "annotation") and self.channels is None and self.first is None and self.last is None

    def samples(self, channel: str) -> bool:
        return self.kind in (None, "samples") and (self.channels is None or channel in self.channels)

    def begins(self, at: int) -> bool:
        return (self.first is None or at >= self.first) and (self.last is None or at <= self.last)


def decode_records(path: str, head: dict, body: bytes, first_record: int, chunk: int = CHUNK, ask: Wanted = Wanted()):
    """Rows of whole data records, starting with record ``first_record``."""
    counts = head["s_samples"]
    width = sum(counts)
    records = np.frombuffer(body, dtype="<i2")
    records = records[: len(records) // width * width].reshape(-1, width)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for i, channel in enumerate(head["s_label"]):
        part = records[:, offsets[i] : offsets[i + 1]]
        if channel == ANNOTATIONS:
            for row in with_text(part) if ask.annotations() else ():
                for onset, duration, text in parse_annotations(row.tobytes()):
                    yield (path, "annotation", None, None, None, None, None, onset, duration, text)
            continue
        if not ask.samples(channel):
            continue
        low, high = float(head["s_phys_min"][i]), float(head["s_phys_max"][i])
        bottom, top = float(head["s_dig_min"][i]), float(head["s_dig_max"][i])
        digital = part.reshape(-1)
        rate = counts[i] / head["duration"] if head["duration"] else float(counts[i])
        begin = first_record * counts[i]
        # Pieces follow the chunk grid, so equal chunk ids line up over channels and ranges.
        at = 0
        while at < len(digital):
            stop = min(len(digital), at + chunk - (begin + at) % chunk)
            if ask.begins(begin + at):
                values = (digital[at:stop] - bottom) * ((high - low) / (top - bottom)) + low
                yield (path, "samples", channel, head["s_unit"][i], rate, begin + at, values, None, None, None)
            at = stop


def batches(rows, size: int = 256):
    """Row tuples as record batches of bounded length."""
    kinds = [pa.string()] * 4 + [pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def file_system(path: str):
    """(file system, name) of a path as Spark lists it: a URI whose name is not escaped, or a plain local path."""
    from pyarrow import fs

    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/") :].lstrip("/")
    for hadoop, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = plain + path[len(hadoop) :] if path.startswith(hadoop) else path
    return fs.FileSystem.from_uri(quote(path, safe=":/"))


def open_file(path: str):
    system, name = file_system(path)
    return system.open_input_file(name)


def write_file(path: str, content: bytes) -> None:
    system, name = file_system(path)
    with system.open_output_stream(name) as f:
        f.write(content)


def list_files(folder: str) -> dict[str, int]:
    """Lengths of the regular files of a folder whose name ends exactly in ``.edf``; sub-folders are left out."""
    from pyarrow import fs

    system, name = file_system(folder)
    found = system.get_file_info(fs.FileSelector(name))
    root = folder.rstrip("/")
    return {f"{root}/{f.base_name}": f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(".edf")}


def read_head(f) -> tuple[int, dict]:
    size = header_bytes(f.read_at(256, 0))
    return size, parse_header(f.read_at(size, 0))


@dataclass
class Range(InputPartition):
    """Byte ranges (path, from, to, whole) of files; ``whole`` if ``to`` is the end of the file."""

    ranges: list[tuple[str, int, int, bool]]


def read_range(path: str, begin: int, end: int, whole: bool, chunk: int, ask: Wanted):
    """Rows of the data records that begin in a byte range, a bounded number at a time.

    The range of a stream ends between records; at the end of a file that is an error.
    """
    with open_file(path) as f:
        size, head = read_head(f)
        record = 2 * sum(head["s_samples"])
        if not record:
            return
        if whole and (end - size) % record:
            raise ValueError(f"{path}: the data does not end with a whole record")
        first, last = (max(0, -(-(at - size) // record)) for at in (begin, end))
        step = max(1, READ_BYTES // record)
        for at in range(first, last, step):
            n = min(step, last - at)
            yield from decode_records(path, head, f.read_at(n * record, size + at * record), at, chunk, ask)


class Options:
    def __init__(self, options):
        self.folder = options.get("path")
        self.files = json.loads(options["files"]) if "files" in options else None
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.chunk = int(options.get("chunk", CHUNK))
        channels = frozenset(json.loads(options["channels"])) if "channels" in options else None
        ends = [int(options[c]) if c in options else None for c in ("first", "last")]
        self.ask = Wanted(options.get("kind"), channels, *ends)

    def lengths(self) -> dict[str, int]:
        return self.files if self.files is not None else list_files(self.folder)


def read_ranges(partition: Range, options: Options):
    """Record batches of all ranges of a task; short files share a batch."""
    return batches(row for part in partition.ranges for row in read_range(*part, options.chunk, options.ask))


class EdfReader(DataSourceReader):
    def __init__(self, options):
        self.options = Options(options)

    def partitions(self) -> list[Range]:
        """Ranges of about ``splitBytes`` bytes: parts of a long file, or several short files, which count ``OPEN_BYTES`` more each."""
        out, held, size = [], [], 0
        for path, length in self.options.lengths().items():
            for at in range(0, length, self.options.split):
                end = min(length, at + self.options.split)
                held.append((path, at, end, end == length))
                size += end - at + OPEN_BYTES
                if size >= self.options.split:
                    out.append(Range(held))
                    held, size = [], 0
        return [*out, Range(held)] if held or not out else out

    def read(self, partition: Range):
        yield from read_ranges(partition, self.options)


class EdfStreamReader(DataSourceStreamReader):
    """Offsets are {path: bytes of whole records}."""

    def __init__(self, options):
        self.options = Options(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, length in self.options.lengths().items():
            with open_file(path) as f:
                size, head = read_head(f) if length >= 256 and length >= header_bytes(f.read_at(256, 0)) else (0, None)
            record = 2 * sum(head["s_samples"]) if head else 0
            if record and length - size >= record:
                out[path] = length - (length - size) % record
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [
            Range([(path, at, min(length, at + self.options.split), False)])
            for path, length in end.items()
            for at in range(start.get(path, 0), length, self.options.split)
        ]

    def read(self, partition: Range):
        yield from read_ranges(partition, self.options)


class EdfSource(DataSource):
    """Options: ``splitBytes``, ``chunk`` (samples of a row), ``files`` (JSON of path and length, in place of a folder),
    ``kind``, ``channels`` (JSON list), ``first`` and ``last`` start_idx; the last three are for samples only."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)

    def streamReader(self, schema) -> EdfStreamReader:
        return EdfStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("edf")`` known to a session."""
    spark.dataSource.register(EdfSource)


def read_recordings(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, chunk: int = CHUNK, **asked) -> DataFrame:
    """Rows of all recordings of a folder, of kind ``samples`` or ``annotation``; ``asked`` takes options of the source."""
    register(spark)
    return spark.read.format("edf").options(splitBytes=split_bytes, chunk=chunk, **asked).load(folder)


def stream_recordings(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The same rows as a stream, as the files of a folder grow."""
    register(spark)
    return spark.readStream.format("edf").option("chunk", chunk).load(folder)


def sample_chunks(decoded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return decoded.filter(F.col("kind") == "samples").select(
        F.col("path").alias("recording_id"),
        "channel",
        F.floor(F.col("start_idx") / chunk).alias("chunk_id"),
        "start_idx",
        "values",
        "unit",
        "rate",
    )


def annotation_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("kind") == "annotation").select(
        F.col("path").alias("recording_id"), "onset_s", "duration_s", "label"
    )


def ingest(spark: SparkSession, folder: str, out: str, chunk: int = CHUNK) -> None:
    """Decode recordings that ``out`` does not have yet; samples and annotations as Parquet by kind.

    A file's rows are committed with those of its run, so a path in ``out`` is there as a whole.
    """
    register(spark)
    files = list_files(folder)
    try:
        known = spark.read.parquet(out).select("path").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        listed = spark.createDataFrame(list(files.items()), "path string, length bigint")
        files = {r["path"]: r["length"] for r in listed.join(known, "path", "left_anti").collect()}  # a listing
    rows = spark.read.format("edf").option("files", json.dumps(files)).option("chunk", chunk).load(folder)
    rows.write.mode("append").partitionBy("kind").parquet(out)


def encode(signals: dict[str, np.ndarray], notes, rate: int, low: float, high: float) -> bytes:
    """A small EDF+ file: one data record per second.  For fixtures and round trips."""
    seconds = -(-max(len(v) for v in signals.values()) // rate)
    texts = [[f"+{s}\x14\x14\x00"] for s in range(seconds)]
    for onset, duration, label in notes:
        texts[min(int(onset), seconds - 1)].append(f"+{onset}\x15{duration}\x14{label}\x14\x00")
    tals = ["".join(t).encode() for t in texts]
    width = -(-max(len(t) for t in tals) // 2)
    names = [*signals, ANNOTATIONS]
    n = len(names)
    values = {
        "label": names,
        "unit": ["uV"] * (n - 1) + [""],
        "phys_min": [f"{low:g}"] * (n - 1) + ["-1"],
        "phys_max": [f"{high:g}"] * (n - 1) + ["1"],
        "dig_min": ["-32768"] * n,
        "dig_max": ["32767"] * n,
        "samples": [str(rate)] * (n - 1) + [str(width)],
    }
    head = {
        "version": "0", "patient": "X", "recording": "X", "date": "01.01.24", "time": "00.00.00",
        "header_bytes": str(256 * (n + 1)), "reserved": "EDF+C", "records": str(seconds),
        "duration": "1", "signals": str(n),
    }
    out = [head[f].ljust(w).encode() for f, w in FILE_FIELDS]
    for f, w in SIGNAL_FIELDS:
        out += [values.get(f, [""] * n)[i].ljust(w).encode() for i in range(n)]
    digits = {
        c: np.rint((np.pad(v, (0, seconds * rate - len(v))) - low) * (65535 / (high - low)) - 32768)
        for c, v in signals.items()
    }
    marks = np.array(tals, f"S{2 * width}").view("<i2").reshape(seconds, width)
    records = [d.astype("<i2").reshape(seconds, rate) for d in digits.values()]
    return b"".join(out) + np.hstack([*records, marks]).tobytes()
