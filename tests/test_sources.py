"""Recording files: decoding, ranges, listing, ingest."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import edf

RATE, SECONDS = 50, 7
NOTES = [(1.5, 2.0, "movement"), (4.0, 2.5, "rest")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("edf")
    signals = wave()
    for name in ("one.edf", "two.edf", "skip.EDF", "skip.edf.bak"):
        path.joinpath(name).write_bytes(edf.encode(signals, NOTES, RATE, -10, 10))
    path.joinpath("nested").mkdir()
    path.joinpath("nested", "deep.edf").write_bytes(b"")
    return str(path)


def wave():
    t = np.arange(RATE * SECONDS) / RATE
    return {"C3": 5 * np.sin(2 * np.pi * t), "C4": t - 3}


def values(decoded, name, channel):
    rows = (
        decoded.filter((F.col("kind") == "samples") & F.col("path").endswith(name) & (F.col("channel") == channel))
        .orderBy("start_idx")
        .collect()
    )
    starts = [r.start_idx for r in rows]
    assert starts == list(np.cumsum([0, *[len(r["values"]) for r in rows[:-1]]]))
    return np.concatenate([r["values"] for r in rows])


def test_listing(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in edf.list_files(folder)] == ["one.edf", "two.edf"]
    assert edf.list_files("file:" + folder) == {"file:" + p: n for p, n in edf.list_files(folder).items()}


@pytest.mark.parametrize("split_bytes", [1 << 20, 500])
def test_decode(spark, folder, split_bytes):
    """Whole files and ranges of records give the same samples and notes."""
    decoded = edf.read_recordings(spark, folder, split_bytes, chunk=64).cache()
    for name in ("one.edf", "two.edf"):
        for channel, want in wave().items():
            assert np.allclose(values(decoded, name, channel), want, atol=20 / 65535)
    notes = edf.annotation_rows(decoded).orderBy("recording_id", "onset_s").collect()
    assert [(r.onset_s, r.duration_s, r.label) for r in notes] == NOTES * 2
    chunks = edf.sample_chunks(decoded, 64)
    assert {r.rate for r in chunks.collect()} == {float(RATE)}
    assert chunks.filter("start_idx < chunk_id * 64 OR start_idx >= chunk_id * 64 + 64").isEmpty()


def test_count_follows_from_the_length(spark, tmp_path):
    """A header without or with a wrong count, and a name with a space, lose nothing."""
    content = edf.encode(wave(), NOTES, RATE, -10, 10)
    for name, count in (("no count.edf", "-1"), ("small.edf", "2")):
        tmp_path.joinpath(name).write_bytes(content[:236] + count.ljust(8).encode() + content[244:])
    for split_bytes in (1 << 20, 500):
        decoded = edf.read_recordings(spark, str(tmp_path), split_bytes, chunk=64)
        for name in ("no count.edf", "small.edf"):
            assert np.allclose(values(decoded, name, "C3"), wave()["C3"], atol=20 / 65535)
    tmp_path.joinpath("broken.edf").write_bytes(content[:-3])
    with pytest.raises(Exception, match="whole record"):
        edf.read_recordings(spark, str(tmp_path)).count()


def test_ingest(spark, folder, tmp_path):
    out = str(tmp_path / "lake")
    edf.ingest(spark, folder, out)
    edf.ingest(spark, folder, out)  # a second run adds nothing
    back = spark.read.parquet(out)
    assert back.filter("kind = 'annotation'").count() == 4
    assert back.filter("kind = 'samples'").select(F.sum(F.size("values"))).first()[0] == 4 * RATE * SECONDS


def test_options_reach_the_reader(spark, folder):
    rows = edf.read_recordings(spark, folder, chunk=64)
    some = edf.read_recordings(spark, folder, chunk=64, channels='["C4"]', first=100, last=299)
    assert sorted({(r.channel, r.start_idx) for r in some.collect()}) == [("C4", 128), ("C4", 192), ("C4", 256)]
    assert some.count() == 6
    notes = edf.read_recordings(spark, folder, kind="annotation")
    assert notes.count() == 4 and notes.filter("kind = 'samples'").isEmpty()
    both = rows.filter("kind = 'annotation'").unionByName(rows.filter("kind = 'samples' AND channel = 'C3'"))
    assert {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()} == {"annotation": 4, "samples": 12}


def test_ranges_share_and_split(folder):
    lengths = edf.list_files(folder)
    for split in (300, 1000, 1 << 20):
        ranges = [r for p in edf.EdfReader({"path": folder, "splitbytes": str(split)}).partitions() for r in p.ranges]
        for path, length in lengths.items():
            own = [(a, b) for p, a, b, _ in ranges if p == path]
            assert own[0][0] == 0 and own[-1][1] == length and all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_short_files_spread_over_tasks():
    """Opening a file costs time too, so many short ones are not left to one task."""
    files = json.dumps({f"/in/{i}.edf": 2000 for i in range(1000)})
    parts = edf.EdfReader({"path": "/in", "files": files}).partitions()
    assert len(parts) > 10 and sum(len(p.ranges) for p in parts) == 1000


def test_growing_recordings_arrive_once(spark, tmp_path):
    """Records that are appended while the stream is down arrive after a restart, each one once; half a record waits."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    content = edf.encode(wave(), NOTES, RATE, -10, 10)
    head = edf.header_bytes(content[:256])
    record = (len(content) - head) // SECONDS
    for n in (head + 2 * record + 7, head + 5 * record, len(content)):
        folder.joinpath("a.edf").write_bytes(content[:n])
        if n == len(content):
            folder.joinpath("b.edf").write_bytes(content)
        run = edf.stream_recordings(spark, str(folder), 64).writeStream.format("parquet").option("checkpointLocation", f"{out}/_state")
        run = run.start(f"{out}/data")
        run.processAllAvailable()
        run.stop()
    back = spark.read.schema(edf.SCHEMA).parquet(f"{out}/data")
    for name in ("a.edf", "b.edf"):
        got = back.filter((F.col("kind") == "samples") & (F.col("channel") == "C3") & F.col("path").endswith(name))
        values = np.concatenate([r["values"] for r in got.orderBy("start_idx").collect()])
        assert np.allclose(values, wave()["C3"], atol=20 / 65535)
    assert back.filter("kind = 'annotation'").count() == 4
