"""The sweep: every recording x grid cell x split x method in one job.

Only raw epochs, sums or small factors of them, and models travel.  Epochs of a recording are hashed into bounded buckets, which the
steps filter under every band inside the task: once to fold them, once for the class sums of their features, once to rate them.  The
splits that test an epoch are a bit pattern, and epochs of one pattern always act together, so they form a fold: the train part of a
split is the sum of the folds that do not have its bit.  One small group per (recording, cell) solves all splits.

A recording with more than ``SHARED`` epochs gets a group of its own for each split, and its buckets pass on one fold for each class, split and
side.  Above ``FAN`` buckets, those are combined ``FAN`` at a time on the way; combining is the same function that a bucket uses anyway.
A recording of few buckets is dealt once for each of several shares of the bands, so that all cores have work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions import solve, taps
from wavemill.functions.scalars import configuration_label
from wavemill.operators import blocks as bk
from wavemill.operators import channels, grid, signal, splits, tensor
from wavemill.operators.apply import arrow_schema, matrix
from wavemill.operators.events import sub_event_offsets, sub_events
from wavemill.operators.signal import fixed_lists
from wavemill.session import materialize, spread

CELL = ["recording_id", "band_id"]
SPLIT = [*CELL, "split_id"]
#: Epochs of one recording whose folds one group takes for all splits.
SHARED = 2_048
FAN = 64
#: Epochs and raw values of one bucket at most, and the tasks a recording is dealt to at least.
GROUP, HELD = 8_192, 2_000_000
APART = 32
#: Bands filtered before their results are passed on.
BANDS = 8
N_COMPONENTS = 32
N_SVD = 10

FOLD = "recording_id string, band_id int, part int, slot bigint, class_id int, pattern bigint, n_channels int, n_times bigint, bad bigint, data array<double>"
MODEL = "recording_id string, band_id int, split_id int, model array<double>, error string"
SUMS = "recording_id string, band_id int, split_id int, class_id int, n bigint, sums array<double>, squares array<double>, error string"
LINES = "recording_id string, band_id int, split_id int, classes array<int>, coef array<double>, intercept array<double>, error string"
HITS = "recording_id string, band_id int, split_id int, hits bigint, cases bigint"


# --- feature methods -------------------------------------------------------


@dataclass(frozen=True)
class Method:
    """``kept``: what is kept of a filtered epoch.  ``combine``: rows of a fold -> fewer rows with the same meaning.
    ``fit``: folds, for each split which of them train -> model or error for each split.  ``apply``: (rows, times, channels, model, test) -> train
    or test features.  ``by_class`` is false if a fit does not tell classes apart.
    """

    kept: str
    combine: Callable
    fit: Callable
    apply: Callable
    by_class: bool = True


def add_up(rows: np.ndarray) -> np.ndarray:
    return rows.sum(axis=0, keepdims=True)


def triangle(rows: np.ndarray) -> np.ndarray:
    """At most as many rows as columns, with the same products X'X."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def csp_fit(rows, classes, times, width, train, components=N_COMPONENTS):
    """Spatial filters from the class covariances of the train folds."""

    def one(own):
        found = np.unique(classes[own])
        if len(found) != 2:
            raise ValueError(f"{len(found)} classes in the train epochs, 2 needed")
        a, b = (rows[own & (classes == c)].sum(0).reshape(width, width) / times[own & (classes == c)].sum() for c in found)
        return solve.joint_diagonal(a, b, min(components, width))[0].reshape(-1)

    return [attempt(one, own) for own in train]


def csp_apply(rows, times, width, model, test):
    """Log mean power w'Gw / T of each filtered component, one product for all epochs; the same for train and test epochs."""
    w = model.reshape(-1, width)
    power = rows @ (w[:, :, None] * w[:, None, :]).reshape(len(w), -1).T
    return np.log(np.maximum(power, np.finfo(float).tiny) / times[:, None])


def parafac_fit(rows, classes, times, width, train):
    """Low-rank decomposition of the train and the test epochs apart, then the leading directions of the train reconstruction.

    The chain from an epoch to its coordinates is linear, so each side's model is one (channels x bins) x components matrix.  The
    decompositions of all splits run as one stack; rows of zeros fill it up.
    """
    good = [s for s, own in enumerate(train) if own.any() and not own.all()]
    out: list = ["no train or no test epochs"] * len(train)
    if not good:
        return out
    x = np.stack([np.where((train[s] if side else ~train[s])[:, None], rows, 0.0) for s in good for side in (True, False)])
    gram = x.swapaxes(1, 2) @ x if x.shape[1] > x.shape[2] else None
    cube = x.reshape(*x.shape[:2], width, -1)
    left = np.einsum("neaf,nebf->nab", cube, cube, optimize=True)
    right = np.einsum("neca,necb->nab", cube, cube, optimize=True)
    b, f = map(np.stack, zip(*(solve.cp_start(p, q, tensor.RANK) for p, q in zip(left, right))))
    product = (lambda v: gram @ v) if gram is not None else lambda v: x.swapaxes(1, 2) @ (x @ v)
    q, b, f, _ = solve.cp_fit(product, (x * x).sum(axis=(1, 2)), b, f, tensor.SWEEPS, tensor.TOL)
    parts = solve.khatri_rao(b, f)

    def one(k):
        weights = x[k] @ q[k]
        basis = solve.leading_in_span(weights, parts[k], N_SVD)
        return np.stack([q[k + i] @ (parts[k + i].T @ basis.T) for i in (0, 1)]).reshape(-1)

    for k, s in enumerate(good):
        out[s] = attempt(one, 2 * k)
    return out


def parafac_apply(rows, times, width, model, test):
    return rows @ model.reshape(2, rows.shape[1], -1)[int(test)]


def attempt(fit, *args):
    """A result, or the reason why there is none."""
    try:
        return fit(*args)
    except (ValueError, np.linalg.LinAlgError) as e:
        return str(e)


METHODS = {
    "csp": Method("gram", add_up, csp_fit, csp_apply),
    "parafac": Method("spectrum", triangle, parafac_fit, parafac_apply, by_class=False),
}


# --- steps -----------------------------------------------------------------


def tested(blocks: DataFrame, split_rows: DataFrame) -> DataFrame:
    """For each epoch the bit pattern of the splits that test it."""
    bit = F.expr("shiftleft(1L, split_id)")
    return split_rows.filter(F.col("role") == "test").groupBy("recording_id", "epoch_id").agg(F.bit_or(bit).alias("tests"))


def bucket_counts(blocks: DataFrame) -> DataFrame:
    """Epochs (``of``), buckets and shares of the bands of each recording."""
    sizes = blocks.groupBy("recording_id").agg(F.count(F.lit(1)).alias("of"), F.max(F.size("data")).alias("_cells"))
    held = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.floor(F.lit(HELD) / F.greatest(F.col("_cells"), F.lit(1)))))
    counted = sizes.withColumn("_buckets", F.ceil(F.col("of") / held).cast("int")).drop("_cells")
    return counted.withColumn("_shares", F.ceil(F.lit(APART) / F.col("_buckets")).cast("int"))


def dealt(blocks: DataFrame, tests: DataFrame, counts: DataFrame) -> DataFrame:
    """Raw blocks with their bit pattern, by bucket and share of the bands."""
    ready = blocks.join(counts, "recording_id").join(tests, ["recording_id", "epoch_id"], "left")
    return (
        ready.withColumn("tests", F.coalesce("tests", F.lit(0)))
        .withColumn("_bucket", F.pmod(F.xxhash64("epoch_id"), F.col("_buckets")).cast("int"))
        .withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    )


BUCKET = ["recording_id", "_bucket", "_share"]


def own_sets(table: pa.Table, sets: dict[int, list[int]]) -> list[int]:
    """The sets in the share of a bucket."""
    share, shares = (table.column(c)[0].as_py() for c in ("_share", "_shares"))
    return [k for at, k in enumerate(sorted(sets)) if at % shares == share]


def filtered(table: pa.Table, bands: list[tuple], how: Method, filtering: dict, by_name: bool):
    """Epochs of a bucket under some bands: {band: (table in the order of epochs, rows)}."""
    run = bk.band_filter(bands, how.kept, by_name=by_name, **filtering)
    found: dict[int, list] = {}
    for batch in run(table.combine_chunks().to_batches()):
        found.setdefault(batch.column("band_id")[0].as_py(), []).append(batch)
    tables = {b: pa.Table.from_batches(own).sort_by("epoch_id") for b, own in found.items()}
    return {b: (t, matrix(t, "data")) for b, t in tables.items()}


def merged(x, label, pattern, times, bad, combine):
    """Folds of one class and pattern: (class, pattern, rows, times of the rows, bad ones).

    A value that is not finite makes a fold bad and takes no part in it.  Classes and patterns are sorted one after the other, as
    sorting pairs of them costs more than filtering the epochs.
    """
    for c in np.unique(label).tolist():
        for p in np.unique(pattern[label == c]).tolist():
            own = (label == c) & (pattern == p)
            good = own & (bad == 0)
            data = combine(x[good]) if good.any() else x[own][:1]
            counts = np.zeros((2, len(data)), np.int64)
            counts[0, 0], counts[1, 0] = times[good].sum(), bad[own].sum()
            yield c, p, data, *counts


def fold_table(rows: list, target: pa.Schema) -> pa.Table:
    """(recording, band, part, slot, channels, folds) as a table."""
    out = []
    for recording, band, part, slot, width, (c, p, data, times, bad) in rows:
        n = len(data)
        columns = [[v] * n for v in (recording, band, part, slot, c, p, width)]
        out.append(pa.table([*(pa.array(v, t) for v, t in zip(columns, target.types)), pa.array(times), pa.array(bad), fixed_lists(data)], schema=target))
    return pa.concat_tables(out) if out else target.empty_table()


def folds(ready: DataFrame, bands: list[tuple], how: Method, n_splits: int, filtering: dict) -> DataFrame:
    """Epochs of each bucket filtered and put together by class and pattern.

    Recordings of up to ``SHARED`` epochs have one part (-1) with the whole bit pattern; others a part for each split, whose
    pattern is 1 for its test epochs.
    """
    target, by_name, shared, step = arrow_schema(FOLD), bk.names_channels(bands), SHARED, BANDS

    def run(table: pa.Table) -> pa.Table:
        own = set(own_sets(table, {b: [b] for b, *_ in bands}))
        mine = [x for x in bands if x[0] in own]
        recording, slot, of = (table.column(c)[0].as_py() for c in ("recording_id", "_bucket", "of"))
        out = []
        for at in range(0, len(mine), step):
            for band, (t, x) in filtered(table, mine[at : at + step], how, filtering, by_name).items():
                label, tests, times = (t.column(c).to_numpy().astype(np.int64) for c in ("class_id", "tests", "n_times"))
                label = label if how.by_class else np.zeros_like(label)
                bad = (~np.isfinite(x).all(axis=1)).astype(np.int64)
                width = t.column("n_channels")[0].as_py()
                for part in [-1] if of <= shared else range(n_splits):
                    pattern = tests if part < 0 else tests >> part & 1
                    out.extend((recording, band, part, slot, width, fold) for fold in merged(x, label, pattern, times, bad, how.combine))
        return fold_table(out, target)

    return spread(ready, *BUCKET).groupBy(*BUCKET).applyInArrow(run, FOLD)


def combined(rows: DataFrame, how: Method) -> DataFrame:
    """Folds of ``FAN`` buckets put together by class and pattern."""
    target, fan = arrow_schema(FOLD), FAN

    def run(table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_numpy() for c in ("class_id", "pattern", "n_times", "bad"))
        recording, band, part, slot, width = (table.column(c)[0].as_py() for c in (*CELL, "part", "slot", "n_channels"))
        return fold_table([(recording, band, part, slot // fan, width, fold) for fold in merged(matrix(table, "data"), *columns, how.combine)], target)

    group = [*CELL, "part", "_wide"]
    wide = rows.withColumn("_wide", F.floor(F.col("slot") / fan))
    return spread(wide, *group).groupBy(*group).applyInArrow(lambda t: run(t.drop_columns(["_wide"])), FOLD)


def fitted(rows: DataFrame, how: Method, n_splits: int) -> DataFrame:
    """(recording_id, band_id, split_id, model, error) from the folds of each (cell, part)."""
    target = arrow_schema(MODEL)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        own = range(n_splits) if part < 0 else [part]
        label, pattern, times, bad = (table.column(c).to_numpy() for c in ("class_id", "pattern", "n_times", "bad"))
        if bad.any():
            found = ["an epoch has values that are not finite"] * len(own)
        else:
            train = [pattern >> (s if part < 0 else 0) & 1 == 0 for s in own]
            found = how.fit(matrix(table, "data"), label, times, table.column("n_channels")[0].as_py(), train)
        key = [table.column(c)[0].as_py() for c in CELL]
        rows = [(*key, s, None, m) if isinstance(m, str) else (*key, s, m, None) for s, m in zip(own, found)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), target.types)], schema=target)

    return spread(rows, *CELL, "part").groupBy(*CELL, "part").applyInArrow(run, MODEL)


def placed(df: DataFrame, counts: DataFrame, sets: dict[int, list[int]]) -> DataFrame:
    """Models of each bucket and share: one row for each place that a band has in a set."""
    listed = [(k, b, at, n) for n, k in enumerate(sorted(sets)) for at, b in enumerate(sets[k])]
    table = df.sparkSession.createDataFrame(listed, "set_id int, band_id int, place int, _at int")
    every = F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("_bucket")
    return (
        df.join(F.broadcast(table), "band_id")
        .join(counts, "recording_id")
        .select("*", every, F.pmod("_at", "_shares").alias("_share"))
        .drop("band_id", "of", "_buckets", "_shares", "_at")
    )


def bucketed(ready: DataFrame, models: DataFrame, bands: list[tuple], sets: dict[int, list[int]], how: Method, filtering: dict, each, schema: str) -> DataFrame:
    """``each(key, known, held, error)`` -> rows for every band set and split of a bucket of epochs.

    ``known`` has the models of the set's bands by place, and ``held`` for each band (table, rows).  The features of a set are those of its
    bands, each by its own model, side by side in the order of the list.
    """
    target, by_name, together = arrow_schema(schema), bk.names_channels(bands), max(1, BANDS // max(len(b) for b in sets.values()))

    def run(table: pa.Table, models: pa.Table) -> pa.Table:
        if not table.num_rows or not models.num_rows:
            return target.empty_table()
        recording = table.column("recording_id")[0].as_py()
        at: dict[int, dict] = {}
        for k, (name, split, place) in enumerate(zip(*(models.column(c).to_pylist() for c in ("set_id", "split_id", "place")))):
            at.setdefault(name, {}).setdefault(split, {})[place] = k
        own = [k for k in own_sets(table, sets) if k in at]
        out = []
        for begin in range(0, len(own), together):
            some = own[begin : begin + together]
            used = {b for k in some for b in sets[k]}
            have = filtered(table, [x for x in bands if x[0] in used], how, filtering, by_name)
            for name in some:
                held = [have.get(b) for b in sets[name]]
                for split, places in sorted(at[name].items()):
                    known = {p: {c: models.column(c)[k] for c in models.column_names} for p, k in places.items()}
                    errors = [e for v in known.values() if (e := v["error"].as_py()) is not None]
                    if None in held or len(known) < len(held):
                        errors.append("a band of the set has no channel")
                    out.extend(each((recording, name, split), known, held, errors[0] if errors else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), target.types)], schema=target) if out else target.empty_table()

    return spread(ready, *BUCKET).groupBy(*BUCKET).cogroup(spread(models, *BUCKET).groupBy(*BUCKET)).applyInArrow(run, schema)


def features(known: dict, held: list, how: Method, test: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features of the train or the test epochs of a split, and their classes."""
    split = known[0]["split_id"].as_py()
    label, tests = (held[0][0].column(c).to_numpy() for c in ("class_id", "tests"))
    own = (tests >> split & 1 == 1) == test
    sides = [
        how.apply(x[own], t.column("n_times").to_numpy()[own], t.column("n_channels")[0].as_py(), known[p]["model"].values.to_numpy(), test)
        for p, (t, x) in enumerate(held)
    ]
    return np.concatenate(sides, axis=1), label[own]


def summed(how: Method):
    """Class sums of the train features."""

    def each(key, known, held, error):
        if error is not None:
            return [(*key, None, 0, None, None, error)]
        x, label = features(known, held, how, False)
        parts = ((c, x[label == c]) for c in np.unique(label).tolist())
        rows = [(*key, c, len(a), a.sum(0), (a.T @ a).reshape(-1), None) for c, a in parts]
        return rows or [(*key, None, 0, None, None, None)]

    return each


def lines(rows: DataFrame) -> DataFrame:
    """The discriminant of each (set, split) from its class sums, or the reason why there is none."""
    target = arrow_schema(LINES)

    def solved(table: pa.Table):
        table = table.filter(pc.is_valid(table.column("class_id")))
        if not table.num_rows:
            raise ValueError("no train epochs")
        label, n = (table.column(c).to_numpy() for c in ("class_id", "n"))
        width = len(table.column("sums")[0])
        sums, squares = matrix(table, "sums"), matrix(table, "squares")
        classes = np.unique(label)
        own = [label == c for c in classes]
        coef, intercept = solve.discriminant(
            np.array([n[m].sum() for m in own], float), np.stack([sums[m].sum(0) for m in own]), squares.sum(0).reshape(width, width)
        )
        return classes, coef.reshape(-1), intercept

    def run(table: pa.Table) -> pa.Table:
        errors = [e for e in table.column("error").to_pylist() if e is not None]
        got = errors[0] if errors else attempt(solved, table)
        key = [table.column(c)[0].as_py() for c in SPLIT]
        row = [*key, None, None, None, got] if isinstance(got, str) else [*key, *got, None]
        return pa.table([pa.array([v], t) for v, t in zip(row, target.types)], schema=target)

    return spread(rows, *SPLIT).groupBy(*SPLIT).applyInArrow(run, LINES)


def rated(how: Method):
    """Test epochs whose class the discriminant names."""

    def each(key, known, held, error):
        x, label = features(known, held, how, True)
        classes, coef, intercept = (known[0][c].values.to_numpy() for c in ("classes", "coef", "intercept"))
        predicted = classes[np.argmax(x @ coef.reshape(len(classes), -1).T + intercept, axis=1)]
        return [(*key, int((predicted == label).sum()), len(label))] if len(label) else []

    return each


# --- the job ---------------------------------------------------------------


def score_blocks(
    blocks: DataFrame, bands: list[tuple], method: str, n_splits: int = splits.N_SPLITS, split_rows: DataFrame | None = None,
    sets: dict[int, list[int]] | None = None, n_components: int = N_COMPONENTS, **filtering,
) -> DataFrame:
    """One row (hits, cases, accuracy, error) per (recording, band, split).

    ``sets`` names lists of band_ids whose features one classifier takes side by side; rows then come by set, under band_id.
    Without it each band is by itself.

    ``blocks`` has recording_id, epoch_id, class_id, data, n_channels [, lead, channels].  ``bands`` are (band_id, low, high) or, with a list of
    channels, (band_id, low, high, names).  A cell with a value that is not finite, a split whose train epochs are not of two classes (csp) and one
    without train or test epochs get rows with an ``error``, whatever the size of the recording.
    """
    if n_splits > 62:
        raise ValueError("the splits of an epoch are kept in 62 bits")
    how = METHODS[method]
    if method == "csp":
        how = replace(how, fit=partial(csp_fit, components=n_components))
    sets = sets or {b: [b] for b, *_ in bands}
    split_rows = splits.shuffle_split(blocks, n_splits) if split_rows is None else split_rows
    if not bk.names_channels(bands):
        blocks = blocks.drop("channels")
    if "lead" not in blocks.columns:
        blocks = blocks.withColumn("lead", F.lit(0))
    blocks = blocks.withColumn("n_channels", F.col("n_channels").cast("int")).withColumn("class_id", F.col("class_id").cast("int"))
    counts = materialize(bucket_counts(blocks))
    ready = dealt(blocks, materialize(tested(blocks, split_rows)), counts)

    def folded(some) -> DataFrame:
        return folds(ready.filter(some), bands, how, n_splits, filtering)

    far = F.col("_buckets") > FAN
    models = materialize(fitted(folded(~far).unionByName(combined(folded(far), how)), how, n_splits))
    right = placed(models, counts, sets)
    found = materialize(lines(bucketed(ready, right, bands, sets, how, filtering, summed(how), SUMS)))
    good = found.filter(F.col("error").isNull()).select("recording_id", F.col("band_id").alias("set_id"), "split_id", "classes", "coef", "intercept")
    right = right.join(good, ["recording_id", "set_id", "split_id"])
    hits = bucketed(ready, right, bands, sets, how, filtering, rated(how), HITS)
    hits = hits.groupBy(*SPLIT).agg(F.sum("hits").alias("hits"), F.sum("cases").alias("cases"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("cases").isNull(), F.lit("no test epochs"))
    return found.select(*SPLIT, "error").join(hits, SPLIT, "left").select(
        *SPLIT, "hits", "cases", (F.col("hits") / F.col("cases")).alias("accuracy"), error.alias("error")
    )


def result_rows(scores: DataFrame, cells: DataFrame, method: str) -> DataFrame:
    """Scores with the columns of the result table."""
    return scores.join(F.broadcast(cells), "band_id").select(
        "recording_id",
        F.lit(method).alias("classifier"),
        "split_id",
        "accuracy",
        "frequency",
        "configuration",
        "frequency_start",
        "frequency_end",
        "error",
    )


def grid_bands(configurations: list[tuple[list[str], int]], start: int = C.SWEEP_START_HZ, stop: int = C.SWEEP_STOP_HZ) -> list[tuple]:
    """(band_id, low, high, names) of every start frequency under every (channels, band width) configuration."""
    cells = [(f, width, names) for f in range(start, stop) for names, width in configurations]
    return [(i, float(f), float(f + w), tuple(names)) for i, (f, w, names) in enumerate(cells)]


def sweep(
    chunks: DataFrame,
    annotations: DataFrame,
    selected: list[str] = C.SWEEP_CHANNELS,
    methods: list[str] = ["csp", "parafac"],
    rate: float = C.SAMPLING_RATE,
    tmin: float = 1.0,
    tmax: float = 3.0,
    n_splits: int = splits.N_SPLITS,
    start: int = C.SWEEP_START_HZ,
    stop: int = C.SWEEP_STOP_HZ,
    widths: list[int] = C.SWEEP_WIDTHS,
    validate: bool = True,
    configurations: list[tuple[list[str], int]] | None = None,
) -> DataFrame:
    """Sweep over all recordings, kept as chunks (see :func:`blocks.to_chunks`).

    ``annotations`` has recording_id, annotation_id, onset_idx, class_id.  ``configurations`` lists (channels, band width), an empty list for
    all channels; without it every width goes with the ``selected`` channels.  All of them share one read, one filtering and one full
    Gram matrix per epoch.  Selected channels without signal are left out per recording; a configuration left without
    channels, and a recording without complete epochs, gets one row that says so.
    """
    spark = chunks.sparkSession
    configurations = configurations or [(list(selected or []), w) for w in widths]
    named = [names for names, _ in configurations]
    wanted = sorted({c for names in named for c in names}) if all(named) else None
    used = channels.select_channels(chunks, wanted)
    if validate:
        power = channels.channel_power(signal.broad_bandpass(bk.chunk_rows(used), rate=rate))
        valid = power.filter(F.col("power") > C.VALID_CHANNEL_THRESHOLD).drop("power")
        used = used.join(valid, ["recording_id", "channel"], "left_semi")
    per_trial = len(sub_event_offsets(rate))
    events = sub_events(annotations, rate).select(
        "recording_id",
        (F.col("annotation_id") * per_trial + F.col("sub_id")).alias("epoch_id"),
        "onset_idx",
        "class_id",
    )
    halo = taps.hamming_length(2.0, rate) // 2
    first, last = round(tmin * rate), round(tmax * rate)
    blocks = materialize(bk.epoch_blocks(used, events, first, last, halo).drop("onset_idx"))
    bands = grid_bands(configurations, start, stop)
    cells = grid_cells(spark, bands)
    out = None
    for method in methods:
        scores = score_blocks(blocks, bands, method, n_splits, n_times=last - first + 1, halo=halo, rate=rate)
        rows = result_rows(scores, cells, method)
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(without_channels(annotations, blocks, cells), allowMissingColumns=True)


def without_channels(annotations: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """(recording_id, configuration, error) where a configuration has no channel or a recording no epoch."""
    lists = cells.select("configuration", "names").distinct()
    have = blocks.groupBy("recording_id").agg(F.first("channels").alias("have"))
    asked = annotations.select("recording_id").distinct().join(have, "recording_id", "left").crossJoin(F.broadcast(lists))
    nothing = F.col("have").isNull() | ((F.size("names") > 0) & (F.size(F.array_intersect("have", "names")) == 0))
    return asked.filter(nothing).select("recording_id", "configuration", F.lit("no valid channel or no complete epoch").alias("error"))


def grid_cells(spark, bands: list[tuple], n_channels: int | None = None) -> DataFrame:
    """Grid cells as a table: band centre, ends, channels and label; ``n_channels`` where bands name none."""
    rows = []
    for b, lo, hi, *names in bands:
        names = list(names[0]) if names else []
        rows.append((b, (lo + hi) / 2, int(hi - lo), names or [""] * (n_channels or 0), names, int(lo), int(hi)))
    schema = "band_id int, frequency double, width int, counted array<string>, names array<string>, frequency_start int, frequency_end int"
    table = spark.createDataFrame(rows, schema)
    return table.withColumn("configuration", configuration_label(F.col("width"), F.col("counted"))).drop("width", "counted")
