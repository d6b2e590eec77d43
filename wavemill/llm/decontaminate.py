"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

A document is contaminated by an item if some window of the item's own word count has a weighted
shingle similarity with the item of at least the threshold: each shingle weighs as often as it
occurs, and the similarity is the sum of the smaller weights over the sum of the larger ones.

Fingerprints lead to such windows.  A window in b + 1 unchanged runs of an item, moved, cut or apart,
has at least b * (shingle - 1) shingles that the item lacks, so a similarity of 0.8 bounds b, and a known
number of words in one run survives unchanged.  Only where an item repeats shingle - 1 words may
a window go from one place to the other for nothing; each such place counts as one more break.
Windows follow the item's size: the longest power of two, with a stride, that must lie inside that
run.  Documents get a 64-bit SimHash of the words of each window at every stride; items get one at every
offset.  Every fingerprint of a document within the Hamming radius of an item's is found through
blocks: with radius + 1 blocks, two fingerprints that differ in at most radius bits agree in one block.
All item-sized windows around each hit are compared exactly.

Items are taken in parts of bounded size, one pass over the documents for each part; the tables
of one part go to every task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import words

#: Bits in which fingerprints may differ.
RADIUS = 3
#: Words of all items of one part; its tables take about 60 bytes a word.
PART_WORDS = 400_000
SIZES = (1, 2, 4, 8, 16, 32)

LEAKS = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def surviving_run(n: int, shingle: int, threshold: float, repeats: int = 0) -> int:
    """Words in one unchanged run that every window of similarity ``threshold`` keeps of an item.

    A window with x shingles of its own shares at least threshold * (s + x) of the item's s.
    """
    s = max(1, n - shingle + 1)
    lost = int(s * (1 - threshold) / (1 + threshold) + 1e-9)
    if shingle < 2:
        return 1
    breaks = lost // (shingle - 1)
    shared = threshold * (s + breaks * (shingle - 1)) - 1e-9
    return max(1, min(n, math.ceil(shared / (breaks + repeats + 1)) + shingle - 1))


def repeated(word: np.ndarray, shingle: int) -> int:
    """Places of an item whose shingle - 1 words stand at another place too."""
    if shingle < 2 or len(word) < shingle:
        return 0
    _, counts = weigh(word, shingle - 1)
    return int(counts[counts > 1].sum())


def window_size(n: int, shingle: int, threshold: float, repeats: int = 0) -> tuple[int, int]:
    """Longest window of a size class, with its stride, that the surviving run must contain."""
    run = surviving_run(n, shingle, threshold, repeats)
    size = max(w for w in SIZES if w == 1 or w + w // 4 <= run)
    return size, max(1, run - size + 1)


def simhash(word: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the ``size`` words (a power of two) from each position ``at`` on, ascending."""
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), 1 << 12):
        own = at[a : a + (1 << 12)]
        base = int(own[0])
        part = np.ascontiguousarray(word[base : int(own[-1]) + size])
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        step = 1
        while step < size:  # ones[i] counts the set bits of the words i to i + step - 1
            ones = ones[:-step] + ones[step:]
            step *= 2
        majority = ones[own - base] > size // 2
        out[a : a + (1 << 12)] = np.packbits(majority, axis=1).view(np.uint64).ravel()
    return out


class HammingIndex:
    """Fingerprints by the value of each of radius + 1 blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.blocks = prints, radius, radius + 1
        self.width = 64 // self.blocks
        self.tables = []
        for k in range(self.blocks):
            value = self.block(prints, k)
            order = np.argsort(value, kind="stable")
            self.tables.append((value[order], order))

    def block(self, prints: np.ndarray, k: int) -> np.ndarray:
        last = k == self.blocks - 1
        bits = 64 - self.width * k if last else self.width
        return (prints >> np.uint64(self.width * k)) & np.uint64((1 << bits) - 1)

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, entry) positions whose fingerprints differ in at most radius bits."""
        left, right = [], []
        for k, (value, order) in enumerate(self.tables):
            wanted = self.block(query, k)
            low, high = np.searchsorted(value, wanted, "left"), np.searchsorted(value, wanted, "right")
            some = np.flatnonzero(high > low)
            for a in range(0, len(some), 1 << 16):
                own = some[a : a + (1 << 16)]
                n = high[own] - low[own]
                q = np.repeat(own, n)
                e = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low[own], n)]
                near = np.bitwise_count(query[q] ^ self.prints[e]) <= self.radius
                left.append(q[near])
                right.append(e[near])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pair[0], pair[1]


class Items:
    """One part of the benchmark: words, shingle weights and fingerprints by window size."""

    def __init__(self, ids: list[int], texts: list[str | None], shingle: int, threshold: float):
        self.ids, self.shingle, self.threshold = ids, shingle, threshold
        self.word, self.first = words.words(pa.array(texts, pa.string()))
        self.n = np.diff(self.first)
        self.weights = [weigh(self.word[a:b], shingle) for a, b in zip(self.first[:-1], self.first[1:])]
        entries: dict[int, list] = {}
        strides: dict[int, int] = {}
        for i, n in enumerate(self.n.tolist()):
            if n:
                size, stride = window_size(n, shingle, threshold, repeated(self.word[self.first[i] : self.first[i + 1]], shingle))
                at = np.arange(n - size + 1)
                entries.setdefault(size, []).append((np.full(len(at), i), at))
                strides[size] = min(stride, strides.get(size, stride))
        self.indexes = []
        for size, parts in sorted(entries.items()):
            item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(self.first[item] + at)
            item, at = item[order], at[order]
            prints = simhash(self.word, size, self.first[item] + at)
            self.indexes.append((size, strides[size], HammingIndex(prints), item, at))

    def leaks(self, word: np.ndarray, first: np.ndarray):
        """(text, item, start, similarity): the best window for each text and item that leaks."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for size, stride, index, item, at in self.indexes:
            counts = np.maximum(0, (np.diff(first) - size) // stride + 1)
            text = np.repeat(np.arange(len(counts)), counts)
            start = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * stride
            q, e = index.within(simhash(word, size, first[text] + start))
            found = np.unique(np.stack([text[q], item[e], start[q], start[q] - at[e]]), axis=1)
            edges = np.flatnonzero((np.diff(found[:2], axis=1) != 0).any(axis=0)) + 1
            for t, i, places, near in np.split(found, edges, axis=1) if found.size else []:
                self.compare(word[first[t[0]] : first[t[0] + 1]], int(t[0]), int(i[0]), size, places.tolist(), near.tolist(), best)
        return [(t, i, -back, sim) for (t, i), (sim, back) in sorted(best.items())]

    def compare(self, own: np.ndarray, t: int, i: int, size: int, places: list[int], near: list[int], best: dict) -> None:
        """Item-sized windows that hold one of the hits, which begin at ``places``; ``near``: where the item would begin."""
        n = int(self.n[i])
        last = len(own) - min(n, len(own))
        item = self.word[self.first[i] : self.first[i + 1]]
        exact = {s: 0 <= s <= len(own) - n and np.array_equal(own[s : s + n], item) for s in set(near)}
        for s in (s for s, same in exact.items() if same):
            best[t, i] = max(best.get((t, i), (0.0, 0)), (1.0, -s))
        spans: list[list[int]] = []
        for place, s in zip(places, near):
            if not exact[s]:
                low, high = max(0, place + size - n), min(last, place)
                if spans and low <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        for low, high in spans:
            self.slide(own, t, i, low, high, best)

    def slide(self, own: np.ndarray, t: int, i: int, low: int, high: int, best: dict) -> None:
        """Similarities of the windows that begin at ``low`` to ``high``, each from the one before."""
        n, known = int(self.n[i]), self.weights[i]
        if n < self.shingle or len(own) < n:
            for start in range(low, high + 1):
                sim = similarity(weigh(own[start : start + n], self.shingle), known)
                if sim >= self.threshold:
                    best[t, i] = max(best.get((t, i), (0.0, 0)), (sim, -start))
            return
        part = own[low : high + n]
        runs, _ = words.shingles(part, np.array([0, len(part)]), self.shingle)
        at = np.minimum(np.searchsorted(known[0], runs), len(known[0]) - 1)
        kind = np.where(known[0][at] == runs, at, -1).tolist()
        room, s, both = known[1].tolist(), n - self.shingle + 1, 0  # room[k] goes below 0 for shingles over the item's weight
        for k, new in enumerate(kind):
            if k >= s and (old := kind[k - s]) >= 0:
                both -= room[old] >= 0
                room[old] += 1
            if new >= 0:
                room[new] -= 1
                both += room[new] >= 0
            if k >= s - 1 and both / (2 * s - both) >= self.threshold:
                best[t, i] = max(best.get((t, i), (0.0, 0)), (both / (2 * s - both), -(low + k - s + 1)))


def weigh(word: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    runs, _ = words.shingles(word, np.array([0, len(word)]), shingle)
    return np.unique(runs, return_counts=True)


def similarity(x, y) -> float:
    """Sum of the smaller over sum of the larger weights."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(x[1][i], y[1][j]).sum())
    either = int(x[1].sum() + y[1].sum()) - both
    return both / either if either else 0.0


def item_parts(benchmark: DataFrame):
    """Items in order of their ids, in parts of PART_WORDS words or one longer item."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len((row["text"] or "").split())
        if held >= PART_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def searched(ids, texts, shingle, threshold):
    """Function from record batches to (part of a batch, its leaks); tables are built once a task."""

    def run(batches):
        items = None
        for batch in batches:
            items = items or Items(ids, texts, shingle, threshold)
            for part in words.pieces(batch, "text", 1 << 20):
                yield part, items, items.leaks(*words.words(part.column("text")))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each document and item that leaks into it: the best window and its similarity.

    An item or text with fewer words than a shingle has its whole sequence as one; null texts and
    texts without words neither leak nor are leaked into; an empty benchmark gives no row; repeated
    rows of documents or items give a row each; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for ids, texts in item_parts(benchmark):

        def find(batches, search=searched(ids, texts, shingle, threshold)):
            for part, items, found in search(batches):
                if found:
                    doc = part.column("doc_id").to_pylist()
                    cols = zip(*((doc[t], items.ids[i], s, int(items.n[i]), sim) for t, i, s, sim in found))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "start_word", "n_words", "similarity"]
                    )

        out = out.union(rows.mapInArrow(find, LEAKS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows without a leak, all columns kept; nothing is shuffled."""
    for ids, texts in item_parts(benchmark):

        def clean(batches, search=searched(ids, texts, shingle, threshold)):
            for part, _, found in search(batches):
                bad = np.zeros(part.num_rows, bool)
                bad[[t for t, *_ in found]] = True
                yield part.filter(pa.array(~bad))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
