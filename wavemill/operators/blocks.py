"""Epoch blocks: the raw samples a band filter needs around each epoch.

Filtering only the blocks gives the same epoch samples as filtering the whole
recording, and every band of a sweep shares one read and one shuffle of the samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill import constants as C
from wavemill.functions import taps
from wavemill.operators.signal import fixed_lists, same_shape
from wavemill.operators.spatial import replaced, schema_with

CHUNK = 4096
# Doubles of filter input worked on at a time inside a task.
CELLS = 1_000_000
# Cells of a filter matrix for each point of a transform up to which the matrix is the cheaper way.
SHORT = 16


def to_chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """Physical form of a recording: one array per channel and ``size`` samples."""
    points = F.sort_array(F.collect_list(F.struct("sample_idx", "value")))
    return (
        samples.groupBy(
            "recording_id", "channel", F.floor(F.col("sample_idx") / size).alias("chunk_id")
        )
        .agg(F.min("sample_idx").alias("start_idx"), points.alias("_p"))
        .select(
            "recording_id",
            "channel",
            "chunk_id",
            "start_idx",
            F.transform("_p", lambda p: p["value"]).alias("values"),
        )
    )


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as one row per sample."""
    return chunks.select(
        "recording_id", "channel", "start_idx", F.posexplode("values").alias("_pos", "value")
    ).select("recording_id", "channel", (F.col("start_idx") + F.col("_pos")).alias("sample_idx"), "value")


def epoch_blocks(
    chunks: DataFrame, events: DataFrame, first: int, last: int, halo: int, size: int = CHUNK
) -> DataFrame:
    """One row per event: channel-major samples from ``first - halo`` to ``last + halo``.

    Events join the one or two chunks they touch, on (recording, chunk), so a long
    recording spreads over its chunks.  ``lead`` counts samples missing in front.
    Events whose own window is not fully recorded are dropped.
    """
    low, high = F.col("onset_idx") + first - halo, F.col("onset_idx") + last + halo
    wanted = events.withColumn(
        "chunk_id", F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))
    )
    begin = F.greatest(F.lit(0), low - F.col("start_idx"))
    end = F.least(F.size("values") - 1, high - F.col("start_idx"))
    pieces = (
        wanted.join(chunks, ["recording_id", "chunk_id"])
        .withColumn("_begin", begin.cast("int"))
        .withColumn("_len", (end - begin + 1).cast("int"))
        .filter(F.col("_len") > 0)
        .select(
            *events.columns,
            "channel",
            (F.col("start_idx") + F.col("_begin")).alias("_from"),
            F.slice("values", F.col("_begin") + 1, F.col("_len")).alias("_piece"),
        )
    )
    sorted_pieces = F.sort_array(F.collect_list(F.struct("channel", "_from", "_piece")))
    return (
        pieces.groupBy(*events.columns)
        .agg(sorted_pieces.alias("_p"), F.min("_from").alias("_start"))
        .withColumn("data", F.flatten(F.transform("_p", lambda p: p["_piece"])))
        .withColumn("channels", F.array_distinct(F.transform("_p", lambda p: p["channel"])))
        .withColumn("n_channels", F.size("channels"))
        .withColumn("lead", (F.col("_start") - low).cast("int"))
        .withColumn("_times", F.size("data") / F.col("n_channels"))
        .filter(
            (F.col("lead") <= halo)
            & (F.col("lead") + F.col("_times") >= halo + last - first + 1)
            & (F.col("_times") == F.floor("_times"))
        )
        .drop("_p", "_start", "_times")
    )


def mirror_pad(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Extend along the last axis by mirroring through the end values; zeros beyond that."""
    n = x.shape[-1]
    head, tail = min(before, n - 1), min(after, n - 1)
    parts = [
        np.zeros((*x.shape[:-1], before - head)),
        2 * x[..., :1] - x[..., head:0:-1],
        x,
        2 * x[..., -1:] - x[..., n - 2 : n - 2 - tail if n - 2 - tail >= 0 else None : -1]
        if tail
        else x[..., :0],
        np.zeros((*x.shape[:-1], after - tail)),
    ]
    return np.concatenate(parts, axis=-1)


def band_epochs(
    blocks: DataFrame,
    bands: list[tuple[int, float, float]],
    output: str,
    n_times: int | None = None,
    halo: int | None = None,
    rate: float = C.SAMPLING_RATE,
    transition: float = 2.0,
    bins: int = 50,
) -> DataFrame:
    """Band-pass every block under every band; one output row per block and band.

    ``output`` picks what is kept of the filtered epoch: ``samples``, its ``gram``
    matrix, or the first ``bins`` magnitudes of its ``spectrum``.  Blocks without
    neighbours (``halo`` 0) are mirrored at their ends.

    A band may name channels, (band_id, low, high, names); then ``channels`` lists those of a block, and of the
    one filtered epoch each band keeps its own, an empty list all.  A block without any of them has no row.
    """
    if "lead" not in blocks.columns:
        blocks = blocks.withColumn("lead", F.lit(0))
    by_name = names_channels(bands)
    run = band_filter(bands, output, n_times, halo, rate, transition, bins, by_name)
    types = dict(blocks.dtypes)
    if types["n_channels"] != "int":
        blocks = blocks.withColumn("n_channels", F.col("n_channels").cast("int"))
    return blocks.mapInArrow(
        run, schema_with(blocks, "n_times int", "band_id int", without=("lead", *(["channels"] if by_name else [])))
    )


def names_channels(bands: list[tuple]) -> bool:
    return any(len(x) > 3 and x[3] for x in bands)


def band_filter(
    bands: list[tuple],
    output: str,
    n_times: int | None = None,
    halo: int | None = None,
    rate: float = C.SAMPLING_RATE,
    transition: float = 2.0,
    bins: int = 50,
    by_name: bool = False,
):
    """The step of :func:`band_epochs` inside a task: batches of blocks to batches of one band each."""
    ends = dict.fromkeys((lo, hi) for _, lo, hi, *_ in bands)
    kernels = [
        (taps.bandpass(lo, hi, rate, transition, transition), [(b, *(names or [()])) for b, *end, names in ((*x[:3], x[3:]) for x in bands) if tuple(end) == (lo, hi)])
        for lo, hi in ends
    ]
    reach = max(len(k) // 2 for k, _ in kernels)
    have = 0 if halo is None else halo

    def places(part: pa.RecordBatch, targets: list) -> list:
        """(band_id, positions of its channels or None for all) of the bands that have a channel here."""
        have = part.column("channels")[0].as_py() if by_name else []
        found = [(band, [have.index(c) for c in names if c in have] if names else None) for band, names in targets]
        return [(band, at) for band, at in found if at is None or at]

    def run(batches):
        responses: dict[int, list] = {}
        matrices: dict[tuple, list] = {}
        for batch in batches:
            for lead_batch, lead in by_value(batch, "lead"):
                for part, x in same_shape(lead_batch, by="channels" if by_name else None):
                    times = n_times or x.shape[2] - 2 * have
                    total = times + 2 * reach
                    front = lead + reach - have
                    size = 1 << (total - 1).bit_length()
                    if size not in responses:
                        responses[size] = [np.fft.rfft(k, size) for k, _ in kernels]

                    def padded(x):
                        x = mirror_pad(x, max(front, 0), max(total - front - x.shape[2], 0))
                        return x[..., max(-front, 0) :][..., :total]

                    def through(spectrum, kernel, response):
                        begin = reach + len(kernel) // 2
                        return np.fft.irfft(spectrum * response, size, axis=2)[:, :, begin : begin + times]

                    wide, short = x.shape[2], x.shape[2] * times <= SHORT * size
                    if short and (wide, times, lead) not in matrices:  # the padded filter as a matrix, by its effect on unit pulses
                        pulses = np.fft.rfft(padded(np.eye(wide)[:, None]), size, axis=2)
                        matrices[wide, times, lead] = [through(pulses, k, r)[:, 0] for (k, _), r in zip(kernels, responses[size])]
                    step = max(1, CELLS // (x.shape[1] * size))
                    own = matrices[wide, times, lead] if short else [None] * len(kernels)
                    kept = [(k, r, m, places(part, targets)) for (k, targets), r, m in zip(kernels, responses[size], own)]
                    part = part.drop_columns(["lead", "channels"] if by_name else ["lead"])
                    for at in range(0, len(x), step):
                        rows = part.slice(at, step)
                        z0 = x[at : at + step]
                        spectrum = None if short else np.fft.rfft(padded(z0), size, axis=2)
                        for kernel, response, effect, targets in kept:
                            if not targets:
                                continue
                            y = through(spectrum, kernel, response) if effect is None else (z0.reshape(-1, wide) @ effect).reshape(*z0.shape[:2], times)
                            if output == "gram":
                                y = y @ y.transpose(0, 2, 1)
                            elif output == "spectrum":
                                y = np.abs(np.fft.rfft(y, axis=2)[:, :, :bins])
                            n = len(y)
                            for band, own in targets:
                                z = y
                                if own is not None:
                                    z = y[:, own][:, :, own] if output == "gram" else y[:, own]
                                yield replaced(
                                    rows,
                                    data=fixed_lists(z.reshape(n, -1)),
                                    n_channels=pa.array(np.full(n, z.shape[1]), pa.int32()),
                                    n_times=pa.array(np.full(n, times), pa.int32()),
                                    band_id=pa.array(np.full(n, band), pa.int32()),
                                )

    return run


def by_value(batch: pa.RecordBatch, column: str):
    """Pieces of a batch that share one value of an integer column."""
    values = batch.column(column).to_numpy()
    for v in np.unique(values):
        yield batch.take(pa.array(np.flatnonzero(values == v))), int(v)
