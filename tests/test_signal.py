"""Filters, wavelets, spectra and epochs against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.functions import taps
from wavemill.operators import blocks, channels, events, signal

RATE = 250


def recording(spark, arrays, name="r"):
    frames = [
        pd.DataFrame(
            {"recording_id": name, "channel": c, "sample_idx": np.arange(len(v)), "value": v}
        )
        for c, v in arrays.items()
    ]
    return spark.createDataFrame(
        pd.concat(frames), "recording_id string, channel string, sample_idx bigint, value double"
    )


def channel(df, name):
    pdf = df.filter(F.col("channel") == name).orderBy("sample_idx").toPandas()
    return pdf["sample_idx"].to_numpy(), pdf["value"].to_numpy()


@pytest.fixture(scope="module")
def noise():
    return np.random.RandomState(1).randn(3000)


def test_lengths():
    assert taps.hamming_length(2.0, 250) == 413
    assert taps.hamming_length(0.5, 250) == 1651
    assert taps.default_transitions(2, 40, 250) == (2.0, 10.0)
    assert len(taps.bandpass(8, 12, 250)) == 413


def test_response():
    size = 4096
    gain = np.abs(np.fft.rfft(taps.bandpass(8, 12, RATE), size))
    hz = np.fft.rfftfreq(size, 1 / RATE)
    assert np.allclose(gain[(hz > 8) & (hz < 12)], 1, atol=0.01)
    assert gain[(hz < 6) | (hz > 14)].max() < 0.01


@pytest.mark.parametrize("length", [1024, 4096])
def test_filter_equals_convolution(spark, noise, length):
    kernel = taps.bandpass(8, 12, RATE)
    df = signal.to_rows(signal.convolve(recording(spark, {"a": noise}), {0: kernel}, "zero", length))
    idx, got = channel(df, "a")
    assert (idx == np.arange(3000)).all()
    assert np.allclose(got, np.convolve(noise, kernel, "same"), atol=1e-12)


@pytest.mark.parametrize("n", [3000, 300, 5])
def test_mirrored_edges(spark, noise, n):
    x, kernel = noise[:n], taps.bandpass(8, 12, RATE)
    half = len(kernel) // 2
    padded = blocks.mirror_pad(x[None], half, half)[0]
    reach = min(half, n - 1)
    assert np.allclose(padded[half - reach : half], 2 * x[0] - x[reach:0:-1])
    assert np.allclose(padded[half + n : half + n + reach], 2 * x[-1] - x[-2 : -2 - reach : -1] if n > reach + 1 else 2 * x[-1] - x[:-1][::-1])
    df = signal.fir_bandpass(recording(spark, {"a": x}), 8, 12)
    assert np.allclose(channel(df, "a")[1], np.convolve(padded, kernel, "valid"), atol=1e-12)


def test_sine_passes_its_band_only(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(2500) / RATE)
    bank = signal.filter_bank(recording(spark, {"a": x}), [(0, 8.0, 12.0), (1, 20.0, 24.0)])
    power = {
        r.band_id: r.p
        for r in bank.filter("sample_idx BETWEEN 500 AND 2000")
        .groupBy("band_id")
        .agg(F.avg(F.col("value") ** 2).alias("p"))
        .collect()
    }
    assert abs(power[0] - 0.5) < 0.01 and power[1] < 1e-4


def test_morlet_equals_convolution(spark, noise):
    x = noise[:1500]
    got = signal.morlet_power(recording(spark, {"a": x}), [6.0, 20.0], RATE, 5.0)
    for f in (6.0, 20.0):
        wave = taps.morlet(f, RATE, 5.0)
        pdf = got.filter(F.col("frequency") == f).orderBy("sample_idx").toPandas()
        want = np.abs(np.convolve(x, wave, "same")) ** 2
        assert np.allclose(pdf["power"], want, atol=1e-10)
        assert np.isclose(np.linalg.norm(wave), np.sqrt(2))


def test_spectrum(spark, noise):
    x = noise[: 3 * 501]
    df = spark.createDataFrame([(1, x.tolist(), 3)], "epoch_id int, data array<double>, n_channels int")
    got = np.reshape(signal.magnitude_spectrum(df).first().data, (3, 50))
    assert np.allclose(got, np.abs(np.fft.rfft(x.reshape(3, 501)))[:, :50])


def test_blocks_equal_continuous_filter(spark, noise):
    """Filtering only around epochs gives the samples of the filtered recording."""
    x = {"a": noise, "b": noise[::-1].copy()}
    samples = recording(spark, x)
    onsets = [0, 900, 1700, 2240, 2260, 2999]
    ev = spark.createDataFrame(
        [("r", i, o, i % 2) for i, o in enumerate(onsets)],
        "recording_id string, epoch_id bigint, onset_idx bigint, class_id int",
    )
    first, last, halo = 250, 750, 206
    filtered = signal.fir_bandpass(samples, 8, 12)
    want = (
        events.epoch_extract(filtered, ev, first, last)
        .groupBy("epoch_id", "channel")
        .agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("p"))
        .collect()
    )
    want = {(r.epoch_id, r.channel): [p.value for p in r.p] for r in want}
    raw = blocks.epoch_blocks(blocks.to_chunks(samples, 512), ev, first, last, halo, 512)
    got = blocks.band_epochs(raw, [(5, 8.0, 12.0)], "samples", 501, halo).collect()
    assert {r.epoch_id for r in got} == {0, 1, 2, 3}
    assert len(want) == 8
    for r in got:
        for c, row in zip(r.channels, np.reshape(r.data, (2, 501))):
            assert np.allclose(row, want[(r.epoch_id, c)], atol=1e-10)


def test_sub_events():
    assert events.sub_event_offsets(250) == [250, 1250]
    assert events.sub_event_offsets(250, offset_s=7) == []
    assert len(events.window_starts(501, 250, 25)) == 11
    assert events.window_starts(50, 250, 25) == []


def test_epoch_plan_has_no_cross_join(spark, noise):
    ev = spark.createDataFrame([("r", 1, 0)], "recording_id string, epoch_id bigint, onset_idx bigint")
    df = events.epoch_extract(recording(spark, {"a": noise}), ev, 0, 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_channel_selection(spark, noise):
    df = recording(spark, {"a": noise[:10], "b": noise[:10]})
    assert channels.select_channels(df, ["a"]).count() == 10
    assert channels.select_channels(df, []).count() == 20
    assert channels.select_channels(df, None).count() == 20


def test_flat_channel_is_invalid(spark, noise):
    df = recording(spark, {"a": noise, "flat": np.zeros(3000), "b": noise})
    power = channels.channel_power(signal.broad_bandpass(df))
    got = {r.channel: (r.role, r.state) for r in channels.channel_validation(power, ["a", "flat"]).collect()}
    assert got == {
        "a": ("selected", "valid"),
        "flat": ("selected", "invalid"),
        "b": ("additional", "valid"),
    }


def test_window_sums(spark):
    df = spark.range(501).select(F.lit(1).alias("e"), F.col("id").cast("int").alias("t"), F.rand(1).alias("value"))
    values = np.array([r.value for r in df.orderBy("t").collect()])
    got = events.sliding_sums(df, ["e"], 501, 250, 25, {"s": F.col("value")}).orderBy("window_id").collect()
    assert [r.window_id for r in got] == list(range(11)) and {r.n for r in got} == {250}
    assert np.allclose([r.s for r in got], [values[25 * w : 25 * w + 250].sum() for w in range(11)])


def test_windows_need_no_table_of_their_own(spark, monkeypatch):
    """Gaps, nulls and times outside: as with a row for each pane, from one aggregate of the keys."""
    rows = [(e, t, None if (e + t) % 5 == 0 else float(e * t)) for e in range(6) for t in range(-2, 14) if (e * t) % 7 != 3 and not (e == 1 and t < 9)]
    df = spark.createDataFrame(rows, "e int, t int, value double")
    sums = {"s": F.col("value"), "q": F.col("value") * 2}
    got = events.sliding_sums(df, ["e"], 9, 4, 2, sums)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2 and "window_id" not in plan.split("HashAggregate", 1)[1]
    got = sorted(map(tuple, got.select("e", "window_id", "s", "q", "n").collect()), key=str)
    monkeypatch.setattr(events, "PANES", 0)
    want = events.sliding_sums(df, ["e"], 9, 4, 2, sums).select("e", "window_id", "s", "q", "n").collect()
    assert got and got == sorted(map(tuple, want), key=str)


def test_label_intervals(spark):
    labels = ["pause", "pause", "rest", "rest", "rest", "pause", "movement", "movement"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "key int, t int, label string")
    got = events.label_intervals(df, "key", "label", ["t"], pause="pause").orderBy("onset_s").collect()
    assert [(r.label, r.onset_s, r.duration_s) for r in got] == [("rest", 1.0, 1.5), ("movement", 3.0, 1.0)]
