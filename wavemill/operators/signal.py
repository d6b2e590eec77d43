"""Convolution of continuous recordings, and spectra of epochs.

A recording is cut into chunks that overlap by half a kernel.  The group a task
works on is one chunk of one channel, so its size does not depend on the length of
the recording, and all kernels share the chunk's one shuffle and one transform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions import taps

KEYS = ["recording_id", "channel"]
# Rows transformed at a time inside a task.
ROWS = 64


def mirrored(samples: DataFrame, halo: int) -> DataFrame:
    """Add up to ``halo`` samples mirrored through the first and the last value."""
    first = F.struct(F.min("sample_idx").alias("i"), F.min_by("value", "sample_idx").alias("v"))
    last = F.struct(F.max("sample_idx").alias("i"), F.max_by("value", "sample_idx").alias("v"))
    ends = samples.groupBy(*KEYS).agg(first.alias("_a"), last.alias("_z"))
    idx, value = F.col("sample_idx"), F.col("value")

    def image(end: str, near):
        row = F.struct(
            (2 * F.col(f"{end}.i") - idx).alias("sample_idx"),
            (2 * F.col(f"{end}.v") - value).alias("value"),
            F.lit(False).alias("real"),
        )
        return F.when(near, row)

    here = F.struct(
        idx.alias("sample_idx"), value.alias("value"), F.lit(True).alias("real")
    )
    before = image("_a", (idx > F.col("_a.i")) & (idx <= F.col("_a.i") + halo))
    after = image("_z", (idx < F.col("_z.i")) & (idx >= F.col("_z.i") - halo))
    return samples.join(ends, KEYS).select(
        *KEYS, F.inline(F.array_compact(F.array(here, before, after)))
    )


def chunked(samples: DataFrame, size: int, halo: int) -> DataFrame:
    """Chunks of ``size`` samples plus ``halo`` neighbours on both sides."""
    idx = F.col("sample_idx")
    ids = F.sequence(F.floor((idx - halo) / size), F.floor((idx + halo) / size))
    point = F.struct("sample_idx", "value", "real")
    return (
        samples.withColumn("chunk_id", F.explode(ids))
        .groupBy(*KEYS, "chunk_id")
        .agg(F.collect_list(point).alias("points"))
        .select(
            *KEYS,
            "chunk_id",
            *[F.col("points")[c].alias(c) for c in ("sample_idx", "value", "real")],
        )
    )


def dense_rows(batch: pa.RecordBatch, size: int, halo: int):
    """Chunk rows as a matrix, and where each home sample sits in it."""
    lists = {c: batch.column(c) for c in ("sample_idx", "value", "real")}
    counts = np.diff(lists["sample_idx"].offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    idx, value, real = (lists[c].flatten().to_numpy(zero_copy_only=False) for c in lists)
    start = batch.column("chunk_id").to_numpy() * size - halo
    col = idx - start[row]
    matrix = np.zeros((len(counts), size + 2 * halo))
    matrix[row, col] = value
    mine = real & (col >= halo) & (col < halo + size)
    return matrix, row[mine], col[mine], idx[mine]


def list_column(row: np.ndarray, n_rows: int, values: np.ndarray) -> pa.ListArray:
    """List array from values that are already grouped by row."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def convolve(
    samples: DataFrame,
    kernels: dict[int, np.ndarray],
    edge: str = "zero",
    length: int = 4096,
    parts: bool = False,
) -> DataFrame:
    """Centred convolution of every channel with every kernel.

    Returns (recording_id, channel, kernel_id, sample_idx[], value[]) per chunk.  Complex
    kernels give the power, or with ``parts`` the real part as ``value`` and the other as
    ``imag``.  ``edge`` is ``zero`` or ``mirror``.
    """
    halo = max(len(k) // 2 for k in kernels.values())
    while length < 4 * halo:
        length *= 2
    size = length - 2 * halo
    if edge == "mirror":
        samples = mirrored(samples, halo)
    else:
        samples = samples.select(*KEYS, "sample_idx", "value", F.lit(True).alias("real"))
    is_complex = any(np.iscomplexobj(k) for k in kernels.values())
    ids = sorted(kernels)
    stack = [kernels[i] for i in ids]

    def run(batches):
        forward, back = (np.fft.fft, np.fft.ifft) if is_complex else (np.fft.rfft, np.fft.irfft)
        responses = [forward(k, length) for k in stack]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                matrix, row, col, idx = dense_rows(batch, size, halo)
                order = np.lexsort((idx, row))
                row, col, idx = row[order], col[order], idx[order]
                spectrum = forward(matrix, axis=1)
                keys = [batch.column(c) for c in KEYS]
                positions = list_column(row, batch.num_rows, idx)
                for kid, kernel, response in zip(ids, stack, responses):
                    full = back(spectrum * response, length, axis=1)
                    out = full[row, col + len(kernel) // 2]
                    if parts:
                        columns = [out.real, out.imag]
                    elif is_complex:
                        columns = [out.real**2 + out.imag**2]
                    else:
                        columns = [out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *keys,
                            pa.array(np.full(batch.num_rows, kid), pa.int32()),
                            positions,
                            *[list_column(row, batch.num_rows, c) for c in columns],
                        ],
                        names=names,
                    )

    types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in KEYS)
    schema += ", kernel_id int, sample_idx array<bigint>, value array<double>"
    names = [*KEYS, "kernel_id", "sample_idx", "value"]
    if parts:
        schema, names = schema + ", imag array<double>", [*names, "imag"]
    return chunked(samples, size, halo).mapInArrow(run, schema)


def to_rows(chunks: DataFrame) -> DataFrame:
    """One row per sample of the convolved chunks."""
    lists = [c for c in ("sample_idx", "value", "imag") if c in chunks.columns]
    rest = [c for c in chunks.columns if c not in lists]
    return chunks.select(*rest, F.inline(F.arrays_zip(*lists)))


def filter_bank(
    samples: DataFrame,
    bands: list[tuple[int, float, float]],
    rate: float = C.SAMPLING_RATE,
    transition: float = 2.0,
    edge: str = "mirror",
) -> DataFrame:
    """Band-pass every channel under every (band_id, low, high) in one job."""
    kernels = {b: taps.bandpass(lo, hi, rate, transition, transition) for b, lo, hi in bands}
    return to_rows(convolve(samples, kernels, edge)).withColumnRenamed("kernel_id", "band_id")


def fir_bandpass(
    samples: DataFrame, low: float, high: float, rate: float = C.SAMPLING_RATE, **options
) -> DataFrame:
    return filter_bank(samples, [(0, low, high)], rate, **options).drop("band_id")


def broad_bandpass(
    samples: DataFrame, low: float = 2.0, high: float = 40.0, rate: float = C.SAMPLING_RATE
) -> DataFrame:
    """Band-pass with default transition widths, as used to validate channels."""
    kernel = taps.bandpass(low, high, rate, *taps.default_transitions(low, high, rate))
    return to_rows(convolve(samples, {0: kernel}, "mirror")).drop("kernel_id")


def morlet_transform(
    samples: DataFrame, frequencies: list[float], rate: float, cycles: float = 7.0, parts: bool = True
) -> DataFrame:
    """Wavelet transform per channel, frequency and sample as (re, im), as long as the signal."""
    kernels = {i: taps.morlet(f, rate, cycles) for i, f in enumerate(frequencies)}
    table = F.array(*[F.lit(float(f)) for f in frequencies])
    return (
        to_rows(convolve(samples, kernels, parts=parts))
        .withColumn("frequency", F.get(table, F.col("kernel_id")))
        .drop("kernel_id")
        .withColumnsRenamed({"value": "re", "imag": "im"})
    )


def morlet_power(
    samples: DataFrame, frequencies: list[float], rate: float, cycles: float = 7.0
) -> DataFrame:
    """Squared magnitude of the wavelet transform."""
    rows = morlet_transform(samples, frequencies, rate, cycles, parts=False)
    return rows.withColumnRenamed("re", "power")


def magnitude_spectrum(epochs: DataFrame, bins: int = 50) -> DataFrame:
    """First ``bins`` magnitudes of the real transform of each channel of an epoch.

    ``data`` is channel-major and stays so: channels x bins.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("data")
            for part, block in same_shape(batch):
                size = np.abs(np.fft.rfft(block, axis=2)[:, :, :bins])
                flat = size.reshape(len(size), -1)
                yield part.set_column(at, "data", fixed_lists(flat))

    return epochs.mapInArrow(run, epochs.schema)


def fixed_lists(matrix: np.ndarray) -> pa.ListArray:
    """Matrix rows as list values."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * k + 1, k) if k else np.zeros(n + 1, int), pa.int32()),
        pa.array(np.ascontiguousarray(matrix, dtype=float).reshape(-1)),
    )


def same_shape(batch: pa.RecordBatch, rows: int = 256, by: str | None = None):
    """Pieces of an epoch batch with one common shape, and one value of ``by``, as (piece, rows x channels x times)."""
    counts = np.diff(batch.column("data").offsets.to_numpy())
    channels = batch.column("n_channels").to_numpy()
    shapes = [counts.astype(np.int64), channels.astype(np.int64)]
    if by is not None:
        seen: dict[tuple, int] = {}
        shapes.append(np.array([seen.setdefault(tuple(v), len(seen)) for v in batch.column(by).to_pylist()], np.int64))
    _, shapes = np.unique(np.stack(shapes), axis=1, return_inverse=True)
    shapes = shapes.ravel()
    for shape in np.unique(shapes):
        members = np.flatnonzero(shapes == shape)
        for at in range(0, len(members), rows):
            part = batch.take(pa.array(members[at : at + rows]))
            flat = part.column("data").flatten().to_numpy()
            yield part, flat.reshape(len(part), int(part.column("n_channels")[0].as_py()), -1)
