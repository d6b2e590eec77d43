"""Scoring of fixed-size blocks with a trained model, in batch and as a stream."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavemill import constants as C
from wavemill.functions import taps
from wavemill.functions.scalars import to_sorted_json
from wavemill.operators import blocks as bk
from wavemill.operators import linear, spatial, splits
from wavemill.streaming.scans import event_time

OUTPUT = "recording_id string, block_id bigint, label int"
STATE = "width int, idx array<bigint>, scans array<double>"


@dataclass(frozen=True)
class BlockModel:
    """Everything a task needs to rate a block; a few small arrays."""

    kernel: np.ndarray
    filters: np.ndarray
    classes: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray
    electrodes: tuple[int, ...]

    def label(self, before: np.ndarray, block: np.ndarray) -> int:
        """Class of a block (scans x channels), given the scans before it."""
        reach = len(self.kernel) // 2
        x = np.concatenate([before, block])[:, list(self.electrodes)].T
        x = bk.mirror_pad(x, reach, reach)
        size = 1 << (x.shape[1] + len(self.kernel) - 1).bit_length()
        full = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(self.kernel, size), size, axis=1)
        y = full[:, 2 * reach : x.shape[1]][:, -len(block) :]
        power = ((self.filters @ y) ** 2).mean(axis=1)
        scores = self.coef @ np.log(np.maximum(power, np.finfo(float).tiny)) + self.intercept
        return int(self.classes[np.argmax(scores)])


def train_model(
    blocks: DataFrame, band: tuple[float, float], n_components: int = 32, **filtering
) -> DataFrame:
    """One model row per recording, trained on the first random split."""
    keys = ["recording_id", "split_id"]
    roles = splits.shuffle_split(blocks, 1)
    grams = bk.band_epochs(blocks, [(0, *band)], "gram", **filtering).persist()
    filters = spatial.csp_filters(spatial.class_covariance(grams, roles, 1), keys, n_components)
    features = spatial.csp_log_power(grams, filters, ["recording_id"]).join(
        roles, [*keys, "epoch_id"]
    )
    models = linear.lda_fit(
        linear.lda_statistics(features.filter(F.col("role") == "train"), keys), keys
    )
    return filters.join(models, keys).select("recording_id", "filters", "classes")


def load_model(
    row, band: tuple[float, float] = C.LIVE_BAND, rate: float = C.SAMPLING_RATE, electrodes=None
) -> BlockModel:
    """Model row -> task-side form.  A row holds at most 32 x 32 filter weights."""
    width = len(row["classes"][0]["coef"])
    filters = np.reshape(row["filters"], (width, -1))
    return BlockModel(
        taps.bandpass(*band, rate),
        filters,
        np.array([c["class_id"] for c in row["classes"]]),
        np.array([c["coef"] for c in row["classes"]]),
        np.array([c["intercept"] for c in row["classes"]]),
        tuple(range(filters.shape[1])) if electrodes is None else tuple(electrodes),
    )


def dealt(scans: DataFrame, size: int, carry: int) -> DataFrame:
    """Each scan with every block that it belongs to or leads into."""
    idx = F.col("scan_idx")
    return scans.withColumn("block_id", F.explode(F.sequence(F.floor(idx / size), F.floor((idx + carry) / size))))


def lead_and_block(idx: np.ndarray, x: np.ndarray, block: int, size: int):
    """(scans right before a block without a gap, its own scans); None if the block is not complete.

    Of scans with one index the last one counts.
    """
    idx, last = np.unique(idx[::-1], return_index=True)
    x = x[::-1][last]
    begin = int(np.searchsorted(idx, block * size))
    if len(idx) - begin != size:
        return None
    gaps = np.flatnonzero(np.diff(idx[: begin + 1]) != 1)
    return x[gaps[-1] + 1 if len(gaps) else 0 : begin], x[begin:]


def score_blocks(scans: DataFrame, model: BlockModel, size: int, carry: int = 0) -> DataFrame:
    """Label of every complete block; up to ``carry`` scans right before it lead into the filter.

    A block that lacks a scan has no label, and a gap before a block cuts its lead.
    """
    grouped = (
        dealt(scans, size, carry)
        .groupBy("recording_id", "block_id")
        .agg(F.sort_array(F.collect_list(F.struct("scan_idx", "ch"))).alias("_s"))
        .select(
            "recording_id",
            "block_id",
            F.transform("_s", lambda s: s["scan_idx"]).alias("idx"),
            F.flatten(F.transform("_s", lambda s: s["ch"].cast("array<double>"))).alias("flat"),
        )
    )

    def run(frames):
        for pdf in frames:
            rows = []
            for rec, block, idx, flat in pdf.itertuples(index=False):
                parts = lead_and_block(np.asarray(idx), np.reshape(flat, (len(idx), -1)), block, size)
                if parts is not None:
                    rows.append((rec, block, model.label(*parts)))
            yield pd.DataFrame(rows, columns=["recording_id", "block_id", "label"])

    return grouped.mapInPandas(run, OUTPUT)


def stream_score(
    scans: DataFrame, model: BlockModel, size: int, carry: int = 0, started: Column | None = None,
    rate: float = C.SAMPLING_RATE, lateness: str = "10 seconds",
) -> DataFrame:
    """Streaming form of :func:`score_blocks`, by the index of the scans.

    State per (recording, block): the scans seen so far, at most ``carry + size``.  It ends when the block is full.
    Scans may come in any order inside a micro-batch and in order over them.  With ``started``, the time at which a row's recording began,
    a block also waits for its whole lead, and what is not complete when all streams are ``lateness`` past its end is rated
    with what there is or dropped.
    """
    rows = dealt(scans, size, carry)
    timeout, clock = GroupStateTimeout.NoTimeout, started is not None
    if clock:
        rows = rows.withColumn("ts", event_time(started, F.col("scan_idx"), rate)).withWatermark("ts", lateness)
        timeout = GroupStateTimeout.EventTimeTimeout

    def step(key, frames, state: GroupState):
        rec, block = key
        idx, x = np.zeros(0, np.int64), None
        if state.exists:
            width, held, flat = state.get
            idx, x = np.asarray(held, np.int64), np.reshape(flat, (-1, width))
        late = clock and state.hasTimedOut
        if not late:
            pdf = pd.concat(frames)
            new = np.stack([np.asarray(c, dtype=float) for c in pdf["ch"]])
            idx = np.concatenate([idx, pdf["scan_idx"].to_numpy()])
            x = new if x is None else np.concatenate([x, new])
        parts = lead_and_block(idx, x, block, size)
        if parts is not None and clock and not late and len(parts[0]) < min(carry, block * size):
            parts = None
        if parts is not None or late:
            state.remove()
        else:
            state.update((x.shape[1], idx.tolist(), x.reshape(-1).tolist()))
            if clock:
                end = pdf["ts"].iloc[0].timestamp() + (int((block + 1) * size) - int(pdf["scan_idx"].iloc[0])) / rate
                state.setTimeoutTimestamp(max(int(end * 1000), state.getCurrentWatermarkMs() + 1))
        done = [] if parts is None else [(rec, block, model.label(*parts))]
        yield pd.DataFrame(done, columns=["recording_id", "block_id", "label"])

    return rows.groupBy("recording_id", "block_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def feedback(labels: DataFrame, movement_class: int = 1) -> DataFrame:
    """One JSON control message per rated block."""
    moving = F.col("label") == movement_class
    message = to_sorted_json({"left": moving, "right": moving, "movement": F.lit(True)})
    return labels.select("recording_id", "block_id", message.alias("value"))
