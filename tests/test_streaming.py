"""Streams in several micro-batches against their batch form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions import taps
from wavemill.operators import blocks, events, throttle
from wavemill.streaming import commands, live, scans, sinks


def write_files(spark, frames, path):
    """One file per frame, written in order, so that each becomes a micro-batch."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def command_rows(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame(
        {
            "key": rng.randint(0, 3, 300),
            "event_id": np.arange(300),
            "command": rng.choice(["left", "right", "rest"], 300),
            "playing_s": rng.choice([0.5, 3.0, 9.0], 300),
        }
    )
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("event_id"))


@pytest.mark.parametrize(
    "stream_rule, batch_rule",
    [
        (commands.stream_change_only, events.change_only),
        (commands.stream_throttle, throttle.throttle),
    ],
)
def test_commands(spark, command_rows, tmp_path, stream_rule, batch_rule):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(
        spark,
        [command_rows.filter(F.col("event_id").between(a, a + 99)) for a in (0, 100, 200)],
        src,
    )
    stream = scans.read_files(spark, src, command_rows.schema, files_per_trigger=1)
    sinks.append_parquet(stream_rule(stream), out)
    got = sinks.result(spark, out, commands.OUTPUT).select("key", "event_id").collect()
    want = batch_rule(command_rows).select("key", "event_id").collect()
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def scan_frame(spark):
    rng = np.random.RandomState(1)
    rows = []
    for rec, n, first in (("a", 1130, 0), ("b", 760, 130)):
        loud = (np.arange(n) + first) // 100 % 2
        for i in range(n):
            x = rng.randn(3) + np.array([4 * loud[i], 4 * (1 - loud[i]), 0]) * np.sin(0.4 * i)
            rows.append((rec, first + i, [float(v) for v in x]))
    return spark.createDataFrame(rows, scans.SCAN_SCHEMA)


MODEL = live.BlockModel(
    taps.bandpass(*C.LIVE_BAND, 250), np.eye(3)[:2], np.array([1, 2]), np.eye(2), np.zeros(2), (0, 1, 2)
)


@pytest.mark.parametrize("carry", [0, 150])
def test_block_scores(spark, scan_frame, tmp_path, carry):
    """Batches that cut blocks apart change nothing; incomplete blocks are not rated."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, 170, 420, 421, 890, 2000]
    write_files(
        spark,
        [scan_frame.filter(F.col("scan_idx").between(a, b - 1)) for a, b in zip(cuts, cuts[1:])],
        src,
    )
    stream = scans.read_files(spark, src, scans.SCAN_SCHEMA, files_per_trigger=1)
    sinks.append_parquet(live.stream_score(stream, MODEL, 100, carry), out)
    got = sorted(map(tuple, sinks.result(spark, out, live.OUTPUT).collect()))
    want = sorted(map(tuple, live.score_blocks(scan_frame, MODEL, 100, carry).collect()))
    assert got == want
    assert {r[1] for r in got if r[0] == "a"} == set(range(11))
    assert {r[1] for r in got if r[0] == "b"} == set(range(2, 8))
    assert len({r[2] for r in got}) == 2


def test_train_then_score(spark):
    """A model trained on epochs recognises blocks of the same classes."""
    rng = np.random.RandomState(3)
    rows, scan_rows = [], []
    for e in range(40):
        x = rng.randn(3, 501)
        x[e % 2] += 5 * np.sin(2 * np.pi * 17 * np.arange(501) / 250)
        rows.append(("r", e, 1 + e % 2, x.reshape(-1).tolist(), 3))
        scan_rows += [("r", e * 501 + i, [float(v) for v in x[:, i]]) for i in range(501)]
    epochs = spark.createDataFrame(
        rows, "recording_id string, epoch_id bigint, class_id int, data array<double>, n_channels int"
    )
    model = live.load_model(live.train_model(epochs, C.LIVE_BAND).first())
    got = live.score_blocks(spark.createDataFrame(scan_rows, scans.SCAN_SCHEMA), model, 501).collect()
    assert len(got) == 40 and all(r.label == 1 + r.block_id % 2 for r in got)
    first = live.feedback(spark.createDataFrame([("r", 0, 1), ("r", 1, 2)], live.OUTPUT)).orderBy("block_id").collect()
    assert [r.value for r in first] == [
        '{"left":true,"movement":true,"right":true}',
        '{"left":false,"movement":true,"right":false}',
    ]


def test_stream_blocks_drop_the_incomplete_last(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(95).select(
        F.lit("r").alias("recording_id"),
        F.lit("c").alias("channel"),
        F.col("id").alias("sample_idx"),
        F.col("id").cast("double").alias("value"),
    )
    write_files(spark, [df.filter("sample_idx < 47"), df.filter("sample_idx >= 47")], src)
    stream = scans.stream_blocks(
        scans.read_files(spark, src, scans.SAMPLE_SCHEMA, 1), 10, [F.sum("value").alias("total")]
    )
    sinks.each_batch(stream, out)
    got = spark.read.parquet(f"{out}/data").orderBy("block_id").collect()
    assert [r.block_id for r in got] == list(range(9))
    assert [r.total for r in got] == [100.0 * b + 45 for b in range(9)]


def late_recordings(spark):
    """Two recordings of 200 samples, the second one five minutes after the first."""
    return spark.range(400).select(
        F.when(F.col("id") < 200, "a").otherwise("b").alias("recording_id"),
        F.lit("c").alias("channel"),
        (F.col("id") % 200).alias("sample_idx"),
        F.col("id").cast("double").alias("value"),
    )


@pytest.mark.parametrize("clock", [False, True])
def test_a_recording_that_starts_late_loses_no_block(spark, tmp_path, clock):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = late_recordings(spark)
    write_files(spark, [df.filter("recording_id = 'a'"), df.filter("recording_id = 'b'")], src)
    began = F.timestamp_seconds(F.when(F.col("recording_id") == "a", 600).otherwise(900)) if clock else None
    stream = scans.stream_blocks(
        scans.read_files(spark, src, scans.SAMPLE_SCHEMA, 1), 10, [F.sum("value").alias("total")], rate=10, started=began
    )
    sinks.each_batch(stream, out)
    got = spark.read.parquet(f"{out}/data").groupBy("recording_id").count().collect()
    assert {r["recording_id"]: r["count"] for r in got} == {"a": 20, "b": 20}


def test_null_and_empty_commands_change_as_in_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    words = ["", None, None, "left", None, None, "left", "left"]
    rows = [(0, k, w, 0.0) for k, w in enumerate(words)] + [(1, 100 + k, None, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "key long, event_id long, command string, playing_s double")
    df = df.withColumn("ts", F.timestamp_seconds("event_id"))
    write_files(spark, [df.filter(F.col("event_id") % 100 < 2), df.filter(F.col("event_id") % 100 == 2), df.filter(F.col("event_id") % 100 > 2)], src)
    stream = scans.read_files(spark, src, df.schema, files_per_trigger=1)
    sinks.append_parquet(commands.stream_change_only(stream), out)
    got = sinks.result(spark, out, commands.OUTPUT).select("key", "event_id").collect()
    assert sorted(got) == sorted(events.change_only(df).select("key", "event_id").collect())


def test_consumer_ends_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(50).select(
        F.lit("r").alias("recording_id"), F.lit("c").alias("channel"),
        F.col("id").alias("sample_idx"), F.lit(0.0).alias("value"),
    )
    write_files(spark, [df.filter(F.floor(F.col("sample_idx") / 10) == i) for i in range(5)], src)
    seen = []

    def more(batch, batch_id):
        seen.append(batch.count())
        return len(seen) < 3

    sinks.run_while(scans.read_files(spark, src, scans.SAMPLE_SCHEMA, 1), more, str(tmp_path / "out"))
    assert seen == [10, 10, 10]


def test_mirrored_block_is_filtered_alone():
    rng = np.random.RandomState(0)
    block = rng.randn(50, 3)
    kernel = MODEL.kernel
    half = len(kernel) // 2
    padded = blocks.mirror_pad(block.T, half, half)
    y = np.array([np.convolve(row, kernel, "valid") for row in padded])
    power = np.log((y[:2] ** 2).mean(axis=1))
    assert MODEL.label(block[:0], block) == 1 + int(np.argmax(power))


def test_missing_and_late_scans_score_as_in_batch(spark, scan_frame, tmp_path):
    """A lost scan costs its own block only, and a gap in front of a block cuts its lead; the state of full blocks ends."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = scan_frame.filter("NOT (recording_id = 'a' AND scan_idx IN (250, 251, 777))")
    cuts = [0, 170, 420, 421, 890, 2000]
    write_files(spark, [frame.filter(F.col("scan_idx").between(a, b - 1)).orderBy(F.rand(1)) for a, b in zip(cuts, cuts[1:])], src)
    stream = scans.read_files(spark, src, scans.SCAN_SCHEMA, files_per_trigger=1)
    sinks.append_parquet(live.stream_score(stream, MODEL, 100, 150), out)
    got = sorted(map(tuple, sinks.result(spark, out, live.OUTPUT).collect()))
    assert got == sorted(map(tuple, live.score_blocks(frame, MODEL, 100, 150).collect()))
    whole = {(r[0], r[1]): r[2] for r in map(tuple, live.score_blocks(scan_frame, MODEL, 100, 0).collect())}
    cut = {(r[0], r[1]): r[2] for r in map(tuple, live.score_blocks(frame, MODEL, 100, 0).collect())}
    assert set(whole) - set(cut) == {("a", 2), ("a", 7)} and all(whole[k] == v for k, v in cut.items())


def test_lead_ends_at_a_gap():
    idx = np.array([7, 3, 5, 6, 9, 8, 8])
    x = np.arange(7.0)[:, None]
    lead, own = live.lead_and_block(idx, x, 4, 2)
    assert lead[:, 0].tolist() == [2, 3, 0] and own[:, 0].tolist() == [6, 4]
    assert live.lead_and_block(idx, x, 5, 2) is None


def test_blocks_wait_for_their_lead_with_a_clock(spark, scan_frame, tmp_path):
    """Scans that come late over micro-batches give batch's answers when recordings have a clock."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = F.col("scan_idx").between(150, 180)
    parts = [scan_frame.filter((F.col("scan_idx") < 600) & ~late), scan_frame.filter(late), scan_frame.filter("scan_idx >= 600")]
    write_files(spark, parts, src)
    stream = scans.read_files(spark, src, scans.SCAN_SCHEMA, files_per_trigger=1)
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sinks.append_parquet(live.stream_score(stream, MODEL, 100, 150, started, 250, "1 minute"), out)
    got = {tuple(r) for r in sinks.result(spark, out, live.OUTPUT).collect()}
    want = {tuple(r) for r in live.score_blocks(scan_frame, MODEL, 100, 150).collect()}
    assert got <= want and {r for r in want if r[0] == "a"} <= got


def test_run_until_progress_says_so(spark, tmp_path):
    """The consumer ends a stream that has more; without more to come an idle stream ends too."""
    src = str(tmp_path / "in")
    rows = spark.range(50).select(F.lit("r").alias("recording_id"), F.lit("c").alias("channel"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("value"))
    write_files(spark, [rows.filter(F.floor(F.col("sample_idx") / 10) == k) for k in range(5)], src)
    stream = scans.read_files(spark, src, scans.SAMPLE_SCHEMA, 1)
    sinks.run_until(stream, str(tmp_path / "some"), lambda p: p.batchId >= 1)
    seen = sinks.result(spark, str(tmp_path / "some"), scans.SAMPLE_SCHEMA).count()
    assert 20 <= seen <= 50
    sinks.run_until(stream, str(tmp_path / "all"), lambda p: False, until_idle=True)
    assert sinks.result(spark, str(tmp_path / "all"), scans.SAMPLE_SCHEMA).count() == 50


def test_commands_of_many_keys_take_few_calls(spark, monkeypatch):
    """Keys share a group: state lists the keys, and a key's state outlives the batch."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    class Rows:
        def withColumn(self, *_):
            return self

        def groupBy(self, name):
            self.by = name
            return self

        def applyInPandasWithState(self, step, *_):
            self.step = step
            return self

    monkeypatch.setattr(commands, "plain_rows", lambda rows: rows)
    rows = commands.stateful(Rows(), commands.pass_changes)
    state = State()
    frame = lambda *r: pd.DataFrame(r, columns=commands.COLUMNS)
    first = pd.concat(rows.step((0,), iter([frame((2, 5, 1, "a", 0), (1, 3, 2, "b", 0)), frame((2, 4, 0, "a", 0), (1, 9, 3, None, 0))]), state))
    assert sorted(first["event_id"]) == [0, 2, 3]
    second = pd.concat(rows.step((0,), iter([frame((2, 8, 4, "a", 0), (1, 10, 5, None, 0), (3, 1, 6, None, 0))]), state))
    assert rows.by == "bucket" and list(second["event_id"]) == [6] and state.get[0] == [1, 2, 3]
