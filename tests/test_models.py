"""Splits, filters, tensors, discriminants and whole sweeps on data with a known answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavemill.functions import solve
from wavemill.operators import blocks, linear, spatial, splits, tensor
from wavemill.plans import running, staged, sweep

RATE = 250
EPOCH_SCHEMA = (
    "recording_id string, epoch_id bigint, class_id int, data array<double>, n_channels int"
)


def epochs_frame(spark, n, channels, times, contrast, seed=0, classes=2, name="r"):
    """Epochs of noise; class c has ``contrast`` times the amplitude in channel c."""
    rng = np.random.RandomState(seed)
    rows = []
    for e in range(n):
        x = rng.randn(channels, times)
        c = e % classes
        x[c] *= contrast
        rows.append((name, e, c + 1, x.reshape(-1).tolist(), channels))
    return spark.createDataFrame(rows, EPOCH_SCHEMA)


# --- splits ----------------------------------------------------------------


def test_split_sizes_and_buckets(spark):
    ids = spark.range(503).select(F.lit("r").alias("recording_id"), F.col("id").alias("epoch_id"))
    plain = splits.shuffle_split(ids)
    small = splits.shuffle_split(ids, bucket=20)
    key = ["split_id", "epoch_id", "role"]
    assert sorted(plain.select(key).collect()) == sorted(small.select(key).collect())
    counts = plain.filter("role = 'test'").groupBy("split_id").count().collect()
    assert len(counts) == 10 and {r["count"] for r in counts} == {101}



# --- solves ----------------------------------------------------------------


def test_joint_diagonal():
    rng = np.random.RandomState(0)
    a, b = (m @ m.T for m in rng.randn(2, 6, 40))
    w, share = solve.joint_diagonal(a, b, 6)
    assert np.allclose(w @ (a + b) @ w.T, np.eye(6), atol=1e-10)
    assert np.allclose(w @ a @ w.T, np.diag(share), atol=1e-10)
    assert (np.diff(np.abs(share - 0.5)) <= 1e-12).all()


def test_joint_diagonal_drops_empty_directions():
    rng = np.random.RandomState(0)
    mix = rng.randn(6, 3)
    a, b = (mix @ m @ m.T @ mix.T for m in rng.randn(2, 3, 40))
    w, _ = solve.joint_diagonal(a, b, 6)
    assert w.shape == (3, 6) and np.allclose(w @ (a + b) @ w.T, np.eye(3), atol=1e-8)


def test_discriminant_equals_textbook():
    rng = np.random.RandomState(0)
    y = rng.randint(0, 3, 300)
    x = rng.randn(300, 4) @ rng.randn(4, 4) + np.eye(3, 4)[y]
    onehot = np.eye(3)[y]
    coef, b = solve.discriminant(onehot.sum(0), onehot.T @ x, x.T @ x)
    means = np.array([x[y == c].mean(0) for c in range(3)])
    pooled = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)) / 297
    inv = np.linalg.inv(pooled)
    scores = x @ inv @ means.T - 0.5 * np.einsum("ci,ij,cj->c", means, inv, means) + np.log(onehot.mean(0))
    got = x @ coef.T + b
    assert np.allclose(got - got[:, :1], scores - scores[:, :1], atol=1e-8)


def plain_als(x, b, f, sweeps):
    """CP-ALS written out over the unfolded tensor."""
    e, c, t = x.shape
    for _ in range(sweeps):
        a = x.reshape(e, -1) @ solve.khatri_rao(b, f) @ np.linalg.pinv((b.T @ b) * (f.T @ f))
        b = x.transpose(1, 0, 2).reshape(c, -1) @ solve.khatri_rao(a, f) @ np.linalg.pinv((a.T @ a) * (f.T @ f))
        f = x.transpose(2, 0, 1).reshape(t, -1) @ solve.khatri_rao(a, b) @ np.linalg.pinv((a.T @ a) * (b.T @ b))
    return np.einsum("er,cr,fr->ecf", a, b, f)


def test_cp_equals_plain_als(spark):
    rng = np.random.RandomState(3)
    x = np.einsum("er,cr,fr->ecf", *(rng.rand(n, 3) for n in (60, 5, 7))) + 0.1 * rng.randn(60, 5, 7)
    rows = [("r", i, 1, v.reshape(-1).tolist(), 5) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, EPOCH_SCHEMA).repartition(4)
    factors = tensor.cp_factors(
        tensor.tensor_gram(df, ["recording_id"]), ["recording_id"], rank=3, sweeps=8, tol=0
    )
    errors = factors.first().errors
    assert len(errors) == 8 and (np.diff(errors) <= 1e-9).all()
    got = tensor.cp_reconstruct(df, factors, ["recording_id"]).orderBy("epoch_id").toPandas()
    got = np.stack(got["data"].to_list()).reshape(x.shape)
    flat = x.reshape(60, -1)
    b, f = solve.cp_start_from_gram(flat.T @ flat, 5, 3)
    assert np.allclose(got, plain_als(x, b, f, 8), atol=1e-8)
    assert np.isclose(np.linalg.norm(x - got) / np.linalg.norm(x), errors[-1], atol=1e-6)


def test_tensor_gram_in_small_pieces(spark, monkeypatch):
    df = epochs_frame(spark, 40, 2, 5, 2.0).withColumn(
        "recording_id", F.concat(F.lit("r"), F.col("epoch_id") % 3)
    )
    monkeypatch.setattr(tensor, "HELD_CELLS", 50)
    got = {(r.recording_id, r.i): r.row for r in tensor.tensor_gram(df, ["recording_id"]).collect()}
    for rec, group in df.toPandas().groupby("recording_id"):
        x = np.stack(group["data"].to_list())
        assert np.allclose([got[(rec, i)] for i in range(10)], x.T @ x)


def test_truncated_svd(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(50, 6)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "k int, epoch_id int, features array<double>")
    basis = linear.svd_basis(linear.feature_gram(df, ["k"]), ["k"], 3)
    got = linear.svd_project(df, basis, ["k"]).orderBy("epoch_id").toPandas()
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(np.stack(got["features"].to_list())), np.abs(x @ vt[:3].T), atol=1e-8)


# --- features --------------------------------------------------------------


def test_log_power_equals_sample_form(spark):
    df = epochs_frame(spark, 30, 4, 50, 3.0)
    keys = ["recording_id", "split_id"]
    roles = splits.shuffle_split(df, 2)
    grams = spatial.epoch_gram(df)
    filters = spatial.csp_filters(spatial.class_covariance(grams, roles, 2), keys)
    got = spatial.csp_log_power(grams, filters, ["recording_id"]).collect()
    data = {r.epoch_id: np.reshape(r.data, (4, 50)) for r in df.collect()}
    w = {r.split_id: np.reshape(r.filters, (4, 4)) for r in filters.collect()}
    assert len(got) == 60
    for r in got:
        want = np.log(((w[r.split_id] @ data[r.epoch_id]) ** 2).mean(axis=1))
        assert np.allclose(r.features, want, atol=1e-10)


def test_window_grams(spark):
    df = epochs_frame(spark, 3, 2, 501, 1.0)
    data = {r.epoch_id: np.reshape(r.data, (2, 501)) for r in df.collect()}
    got = spatial.window_gram(df, 250, 25).collect()
    assert len(got) == 33
    for r in got:
        x = data[r.epoch_id][:, 25 * r.window_id : 25 * r.window_id + 250]
        assert np.allclose(r.data, (x @ x.T).reshape(-1)) and r.n_times == 250


def test_one_class_is_reported(spark):
    df = epochs_frame(spark, 10, 2, 20, 1.0).withColumn("class_id", F.lit(1))
    grams = spatial.epoch_gram(df)
    roles = splits.shuffle_split(df, 1)
    row = spatial.csp_filters(spatial.class_covariance(grams, roles, 1)).first()
    assert row.filters is None and "1 classes" in row.error


# --- sweeps ----------------------------------------------------------------


def accuracies(scores):
    return {
        (r.recording_id, r.band_id, r.split_id): (r.accuracy, r.error) for r in scores.collect()
    }


@pytest.mark.parametrize("method", ["csp", "parafac"])
def test_separable_and_shuffled(spark, method):
    clear = epochs_frame(spark, 40, 4, 501, 5.0, name="clear")
    rng = np.random.RandomState(9)
    labels = spark.createDataFrame(
        pd.DataFrame({"epoch_id": np.arange(40), "other": rng.permutation(np.arange(40) % 2) + 1})
    )
    mixed = (
        epochs_frame(spark, 40, 4, 501, 5.0, seed=4, name="mixed")
        .join(labels, "epoch_id")
        .withColumn("class_id", F.col("other").cast("int"))
        .select(*clear.columns)
    )
    scores = sweep.score_blocks(clear.unionByName(mixed), [(0, 8.0, 12.0)], method)
    got = {r.recording_id: r.a for r in scores.groupBy("recording_id").agg(F.avg("accuracy").alias("a")).collect()}
    assert got["clear"] > (0.99 if method == "csp" else 0.85)
    assert 0.2 < got["mixed"] < 0.8


def test_one_class_recording_is_skipped_visibly(spark):
    good = epochs_frame(spark, 20, 2, 60, 4.0, name="good")
    bad = epochs_frame(spark, 20, 2, 60, 4.0, name="bad").withColumn("class_id", F.lit(1))
    df = good.unionByName(bad)
    got = accuracies(sweep.score_blocks(df, [(0, 8.0, 12.0)], "csp", 2))
    assert all((a is None) == (r == "bad") for (r, _, _), (a, _) in got.items())
    assert all("classes" in e for (r, _, _), (_, e) in got.items() if r == "bad")
    assert len(got) == 4


def test_sweep_from_samples(spark):
    """Recordings to result rows: validation, events, blocks, both methods, whole grid columns."""
    rng = np.random.RandomState(2)
    seconds, trials = 12, 10
    n = seconds * trials * RATE
    t = np.arange(n) / RATE
    trial = np.minimum(np.arange(n) // (seconds * RATE), trials - 1)
    frames = []
    for c in ("C3", "C4", "CZ"):
        x = 0.3 * rng.randn(n)
        if c == "C3":
            x = x + np.where(trial % 2 == 0, 2.0, 0.2) * np.sin(2 * np.pi * 10 * t)
        if c == "C4":
            x = x + np.where(trial % 2 == 1, 2.0, 0.2) * np.sin(2 * np.pi * 10 * t + 1)
        if c == "CZ":
            x = np.zeros(n)
        frames.append(pd.DataFrame({"recording_id": "r", "channel": c, "sample_idx": np.arange(n), "value": x}))
    flat = pd.DataFrame({"recording_id": "flat", "channel": "C3", "sample_idx": np.arange(n), "value": 0.0})
    samples = spark.createDataFrame(pd.concat([*frames, flat]))
    marks = spark.createDataFrame(
        [(r, i, i * seconds * RATE, 1 + i % 2) for r in ("r", "flat") for i in range(trials)],
        "recording_id string, annotation_id bigint, onset_idx bigint, class_id int",
    )
    out = sweep.sweep(blocks.to_chunks(samples), marks, start=9, stop=10, widths=[2], n_splits=4).cache()
    good = out.filter("recording_id = 'r'").collect()
    assert len(good) == 8 and {r.classifier for r in good} == {"csp", "parafac"}
    assert all(r.error is None and r.accuracy == 1.0 for r in good)
    assert {(r.frequency, r.frequency_start, r.frequency_end, r.configuration) for r in good} == {
        (10.0, 9, 11, "2Hz width 11 channels")
    }
    assert [r.error for r in out.filter("recording_id = 'flat'").collect()] == [
        "no valid channel or no complete epoch"
    ]


def test_two_stages(spark):
    df = epochs_frame(spark, 60, 4, 400, 6.0, classes=3).withColumn("class_id", F.col("class_id") - 1)
    got = staged.two_stage_predictions(df, [(0, 8.0, 12.0)], n_splits=2)
    rows = got.collect()
    assert len(rows) == 24
    assert np.mean([r.predicted == r.actual for r in rows]) > 0.8


def test_two_stage_windows(spark):
    df = epochs_frame(spark, 60, 4, 400, 6.0, classes=3).withColumn("class_id", F.col("class_id") - 1)
    got = staged.two_stage_scores(df, [(0, 8.0, 12.0)], window=(250, 25), n_splits=1).collect()
    assert [sorted(r.window_id for r in got), {r.cases for r in got}] == [list(range(6)), {12}]
    assert np.mean([r.accuracy for r in got]) > 0.7


def test_running_scores(spark):
    df = epochs_frame(spark, 40, 3, 501, 5.0)
    got = running.running_scores(df, [(3, 8.0, 12.0)], n_splits=2).orderBy("split_id", "window_id").collect()
    assert len(got) == 22 and {r.cases for r in got} == {8}
    assert [r.center_s for r in got[:2]] == [1.5, 1.6]
    assert np.mean([r.accuracy for r in got]) > 0.9


def test_mirror_pad_of_blocks():
    x = np.arange(6.0).reshape(1, 6) ** 2
    y = blocks.mirror_pad(x, 7, 2)
    assert y.tolist() == [[0, 0, -25, -16, -9, -4, -1, 0, 1, 4, 9, 16, 25, 34, 41]]


# --- folds -----------------------------------------------------------------


def one_by_one(data, labels, tests, method, channels):
    """Accuracies of the splits of one cell, each from its own epochs in plain numpy."""
    out = []
    for test in tests:
        if method == "csp":
            gram = data.reshape(len(data), channels, -1)
            times = gram.shape[2]
            gram = gram @ gram.transpose(0, 2, 1)
            a, b = (gram[~test & (labels == c)].mean(0) / times for c in np.unique(labels))
            w, _ = solve.joint_diagonal(a, b, channels)
            x = np.log(((w @ gram) * w).sum(axis=2) / times)
            train, rated = x[~test], x[test]
        else:
            spectra = np.abs(np.fft.rfft(data.reshape(len(data), channels, -1), axis=2)[:, :, :50])
            parts = []
            for side in (~test, test):
                x = spectra[side]
                flat = x.reshape(len(x), -1)
                b, f = solve.cp_start(np.einsum("eaf,ebf->ab", x, x), np.einsum("eca,ecb->ab", x, x), tensor.RANK)
                q, b, f, _ = solve.cp_fit(lambda v: flat.T @ (flat @ v), np.array([(flat**2).sum()]), b[None], f[None], tensor.SWEEPS, tensor.TOL)
                parts.append(flat @ q[0] @ solve.khatri_rao(b[0], f[0]).T)
            _, _, turn = np.linalg.svd(parts[0], full_matrices=False)
            train, rated = (p @ turn[: sweep.N_SVD].T for p in parts)
        means = np.stack([train[labels[~test] == c].mean(0) for c in np.unique(labels)])
        onehot = np.eye(2)[np.searchsorted(np.unique(labels), labels[~test])]
        coef, intercept = solve.discriminant(onehot.sum(0), onehot.T @ train, train.T @ train)
        assert np.allclose(onehot.T @ train / onehot.sum(0)[:, None], means)
        out.append(float((np.unique(labels)[np.argmax(rated @ coef.T + intercept, axis=1)] == labels[test]).mean()))
    return out


@pytest.mark.parametrize("method", ["csp", "parafac"])
def test_sweep_equals_each_split_by_itself(spark, method):
    df = epochs_frame(spark, 40, 3, 60, 2.5)
    split_rows = splits.shuffle_split(df, 3)
    got = accuracies(sweep.score_blocks(df, [(0, 8.0, 12.0)], method, 3, split_rows=split_rows))
    tested = {(r.epoch_id, r.split_id) for r in split_rows.filter("role = 'test'").collect()}
    filtered = blocks.band_epochs(df, [(0, 8.0, 12.0)], "samples").orderBy("epoch_id").collect()
    tests = [np.array([(r.epoch_id, s) in tested for r in filtered]) for s in range(3)]
    data, labels = np.array([r.data for r in filtered]), np.array([r.class_id for r in filtered])
    assert [got["r", 0, s][0] for s in range(3)] == one_by_one(data, labels, tests, method, 3)


@pytest.mark.parametrize("method", ["csp", "parafac"])
def test_many_epochs_give_what_few_give(spark, monkeypatch, method):
    """A recording with parts and slots of its own, combined level by level, and its copy that shares one group."""
    df = epochs_frame(spark, 60, 3, 60, 2.5)
    few = accuracies(sweep.score_blocks(df, [(0, 8.0, 12.0), (1, 20.0, 24.0)], method, 3))
    for name, value in (("SHARED", 5), ("FAN", 3), ("GROUP", 7)):
        monkeypatch.setattr(sweep, name, value)
    many = accuracies(sweep.score_blocks(df, [(0, 8.0, 12.0), (1, 20.0, 24.0)], method, 3))
    assert len(few) == 6 and few == many


@pytest.mark.parametrize("shared", [2048, 5])
@pytest.mark.parametrize("method", ["csp", "parafac"])
def test_bad_epochs_and_short_recordings_are_reported(spark, monkeypatch, method, shared):
    """The same rows at any size: a value that is not finite, a single epoch, and a recording that is fine."""
    monkeypatch.setattr(sweep, "SHARED", shared)
    good = epochs_frame(spark, 20, 2, 60, 4.0, name="good")
    nan = F.when(F.col("epoch_id") == 3, F.transform("data", lambda v, i: F.when(i == 7, F.lit(float("nan"))).otherwise(v))).otherwise(F.col("data"))
    bad = epochs_frame(spark, 20, 2, 60, 4.0, name="bad").withColumn("data", nan)
    single = epochs_frame(spark, 20, 2, 60, 4.0, name="single").filter("epoch_id = 0")
    got = accuracies(sweep.score_blocks(good.unionByName(bad).unionByName(single), [(0, 8.0, 12.0)], method, 2))
    assert len(got) == 6
    assert all(got["good", 0, s][1] is None and got["good", 0, s][0] is not None for s in range(2))
    assert all(got["bad", 0, s] == (None, "an epoch has values that are not finite") for s in range(2))
    assert all(got["single", 0, s][0] is None and got["single", 0, s][1] for s in range(2))


def test_channel_lists_and_band_sets(spark):
    """Lists take their channels by name; a list without channels has no rows; a set joins the features of its bands."""
    df = epochs_frame(spark, 30, 3, 60, 3.0).withColumn("channels", F.array(F.lit("A"), F.lit("B"), F.lit("C")))
    bands = [(0, 8.0, 12.0, ("C", "A")), (1, 8.0, 12.0, ()), (2, 20.0, 24.0, ("B", "Z")), (3, 20.0, 24.0, ("Z",))]
    grams = blocks.band_epochs(df, bands, "gram").collect()
    assert {r.band_id: r.n_channels for r in grams} == {0: 2, 1: 3, 2: 1}
    whole = {r.epoch_id: np.reshape(r.data, (3, 3)) for r in grams if r.band_id == 1}
    for r in grams:
        if r.band_id == 0:
            assert np.allclose(np.reshape(r.data, (2, 2)), whole[r.epoch_id][np.ix_([2, 0], [2, 0])])
    sets = {0: [0, 1], 1: [1], 2: [1, 3]}
    got = accuracies(sweep.score_blocks(df, bands, "csp", 2, sets=sets))
    alone = accuracies(sweep.score_blocks(df, [(1, 8.0, 12.0)], "csp", 2))
    assert [got["r", 1, s] for s in range(2)] == [alone["r", 1, s] for s in range(2)]
    assert all(got["r", 0, s][1] is None and got["r", 2, s][1] == "a band of the set has no channel" for s in range(2))


def test_folds_of_a_long_recording_do_not_grow_with_its_epochs(spark, monkeypatch):
    """A bucket passes on one row for each band, split, class and side, and no row for each epoch, band and split."""
    monkeypatch.setattr(sweep, "SHARED", 5)
    df = epochs_frame(spark, 200, 3, 60, 2.5).withColumn("lead", F.lit(0))
    tests = sweep.tested(df, splits.shuffle_split(df, 3))
    ready = sweep.dealt(df, tests, sweep.bucket_counts(df))
    rows = sweep.folds(ready, [(0, 8.0, 12.0), (1, 20.0, 24.0)], sweep.METHODS["csp"], 3, {})
    assert rows.count() == 2 * 3 * 2 * 2


@pytest.mark.parametrize("output", ["samples", "gram", "spectrum"])
def test_filter_by_matrix_equals_filter_by_transform(spark, monkeypatch, output):
    df = epochs_frame(spark, 6, 3, 60, 2.5)
    found = []
    for short in (0, 10**6):
        monkeypatch.setattr(blocks, "SHORT", short)
        rows = blocks.band_epochs(df, [(0, 8.0, 12.0), (1, 20.0, 24.0)], output, rate=80).orderBy("band_id", "epoch_id").collect()
        found.append(np.array([r.data for r in rows]))
    assert np.allclose(*found, rtol=1e-9, atol=1e-9)


def test_folds_sort_classes_and_patterns_by_themselves(monkeypatch):
    """Pairs of class and pattern come in order and whole, without a sort of pairs."""
    rng = np.random.default_rng(3)
    label, pattern, bad = rng.integers(-1, 2, 500), rng.integers(0, 1 << 62, 9)[rng.integers(0, 9, 500)], rng.integers(0, 2, 500)
    x, times = rng.normal(size=(500, 3)), rng.integers(1, 9, 500)
    unique = np.unique

    def of_one_row(values, *args, axis=None, **more):
        assert axis is None
        return unique(values, *args, **more)

    monkeypatch.setattr(np, "unique", of_one_row)
    got = list(sweep.merged(x, label, pattern, times, bad, sweep.add_up))
    assert [g[:2] for g in got] == sorted(set(zip(label.tolist(), pattern.tolist())))
    for c, p, data, n, wrong in got:
        own = (label == c) & (pattern == p)
        good = own & (bad == 0)
        assert np.allclose(data, x[good].sum(0) if good.any() else x[own][:1])
        assert (n[0], wrong[0]) == (times[good].sum(), bad[own].sum())
