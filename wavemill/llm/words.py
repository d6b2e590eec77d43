"""Words of whole texts as 64-bit hashes, computed for a whole Arrow batch at once.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased first.
UTF-8 keeps those bytes for themselves, so texts need not be decoded.  All functions
take the bytes of a text column end to end and work on numpy arrays, never word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator, a bijection on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit numbers evenly; a salt gives another, unrelated spread."""
    with np.errstate(over="ignore"):
        return _splitmix(x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column end to end, and where each text begins (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes outside ``gap``), and each text's first word."""
    inside = ~gap[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edges = offsets[:-1][(offsets[1:] > offsets[:-1])]
    begin[edges] = inside[edges]
    last = edges[edges > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, from its bytes taken eight at a time."""
    low = np.concatenate([LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", low, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    out = mix(length)
    at, left, live, step = starts, length, np.arange(len(starts)), 0
    with np.errstate(over="ignore"):
        while len(live):
            cut = np.uint64(8) - np.minimum(left, np.uint64(8))
            part = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (cut * np.uint64(8)))
            out[live] += mix(part, 1 + step)
            more = left > np.uint64(8)
            at, left, live, step = at[more] + 8, left[more] - np.uint64(8), live[more], step + 1
        return _splitmix(out)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and where each text's words begin."""
    raw, offsets = buffers(column)
    starts, ends, first = spans(raw, offsets)
    return hashes(raw, starts, ends), first


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and where each text's begin.

    A text with fewer words has its whole sequence as one run, one without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(begin[-1]), np.uint64)
    with np.errstate(over="ignore"):
        full = np.repeat(counts >= size, runs)
        at = np.arange(len(out)) - np.repeat(begin[:-1] - first[:-1], runs)
        where = at[full]
        acc = np.zeros(len(where), np.uint64)
        for k in range(size):
            acc = acc * np.uint64(0x2545F4914F6CDD1D) + word[where + k]
        out[full] = _splitmix(acc + np.uint64(size))
        for d in np.flatnonzero((counts > 0) & (counts < size)):
            acc = np.zeros(1, np.uint64)
            for k in range(first[d], first[d + 1]):
                acc = acc * np.uint64(0x2545F4914F6CDD1D) + word[k]
            out[begin[d]] = _splitmix(acc + np.uint64(counts[d]))[0]
    return out, begin


def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, their counts, and where each text's begin."""
    v = values.copy()
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        v[a:b].sort()
    t = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(v)))
    return v[at], counts, np.searchsorted(t[at], np.arange(len(begin)))


def pieces(batch: pa.RecordBatch, text: str, limit: int = 4 << 20):
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a long text stays whole."""
    column = batch.column(text)
    size = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
