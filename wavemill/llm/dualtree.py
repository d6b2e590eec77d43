"""Exact ranked lexical search with two trees.

One pass over the documents finds, for the terms of a part of the items, each document's vector of term counts, and the
corpus-wide statistics.  A second one searches.  Each task builds trees over blocks of document vectors and one over the items;
alike vectors lie side by side, and every node holds the maximum of each coordinate below it.  The product of two nodes' maxima
bounds the score of every item under the one with every document under the other.  A pair of nodes whose
bound is below the weakest k-th score of its items is dropped with all that lies under it; ties are not dropped.

Scores are whole numbers, so bounds are exact.  A first search of a hash share of the documents gives k-th scores that no item's final
one can be below, and the search of all documents starts from them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm import words
from wavemill.llm.decontaminate import item_parts
from wavemill.llm.shared import kept, lists

#: A term is a run of bytes other than these; digits, letters and all non-ASCII characters belong to terms.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Vectors under a leaf, documents and coordinates of a tree.
LEAF = 16
TREE_DOCS = 4096
TREE_TERMS = 4 << 20
#: One of so many documents takes part in the first search.
FIRST = 16

VECTORS = "kind int, doc_id long, n long, docs long, terms array<int>, counts array<long>"
HITS = "item int, doc_id long, score long"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts end to end, and where each text's terms begin."""
    raw, offsets = words.buffers(column)
    starts, ends, first = words.spans(raw, offsets, GAP)
    return words.hashes(raw, starts, ends), first


def vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows of two kinds.  0: a document with known terms, n of all its terms, and how often it has each known one.
    1: of one task, the documents that have terms (docs), all their terms (n), and the documents that hold each known term.
    """

    def run(batches):
        held = np.zeros(len(vocabulary), np.int64)
        docs_seen = terms_seen = 0
        for batch in batches:
            for part in words.pieces(batch, "text"):
                term, first = terms_of(part.column("text"))
                n = np.diff(first)
                docs_seen += int((n > 0).sum())
                terms_seen += int(n.sum())
                at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                known = vocabulary[at] == term
                code = np.repeat(np.arange(len(n)), n)[known] * len(vocabulary) + at[known]
                code, count = np.unique(code, return_counts=True)
                owner, which = np.divmod(code, len(vocabulary))
                held += np.bincount(which, minlength=len(vocabulary))
                begin = np.searchsorted(owner, np.arange(len(n) + 1))
                some = np.flatnonzero(np.diff(begin))
                edges = np.append(begin[some], begin[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(some), np.int32)),
                        part.column("doc_id").take(pa.array(some)),
                        pa.array(n[some]),
                        pa.nulls(len(some), pa.int64()),
                        lists(which, edges, pa.int32()),
                        lists(count, edges, pa.int64()),
                    ],
                    names=["kind", "doc_id", "n", "docs", "terms", "counts"],
                )
        some = np.flatnonzero(held)
        edges = np.array([0, len(some)])
        cols = [pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([terms_seen], pa.int64()), pa.array([docs_seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*cols, lists(some, edges, pa.int32()), lists(held[some], edges, pa.int64())],
            names=["kind", "doc_id", "n", "docs", "terms", "counts"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


class Sparse:
    """Rows of (term, value), terms ascending in each row."""

    def __init__(self, begin: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.begin, self.term, self.value = begin, term, value

    def __len__(self) -> int:
        return len(self.begin) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of rows, and where each row's begin among them."""
        size = self.begin[rows + 1] - self.begin[rows]
        edge = np.concatenate([[0], np.cumsum(size)])
        return np.arange(edge[-1]) + np.repeat(self.begin[rows] - edge[:-1], size), edge

    def take(self, rows: np.ndarray) -> Sparse:
        at, edge = self.entries(rows)
        return Sparse(edge, self.term[at], self.value[at])

    def products(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Products of rows with dense vectors (... x terms); rows are not empty."""
        at, edge = self.entries(rows)
        return np.add.reduceat(dense[..., self.term[at]] * self.value[at], edge[:-1], axis=-1)

    def maxima(self) -> Sparse:
        """One row: the maximum of each coordinate."""
        order = np.lexsort((self.value, self.term))
        term = self.term[order]
        last = np.flatnonzero(np.append(term[1:] != term[:-1], True))
        return Sparse(np.array([0, len(last)]), term[last], self.value[order][last])


class Tree:
    """Balanced binary tree; node v has rows lo[v] to hi[v] of ``rows`` and children 2v + 1 and 2v + 2 if it is no leaf."""

    def __init__(self, rows: Sparse, width: int, leaf: int = LEAF):
        self.depth = max(0, math.ceil(math.log2(max(1, len(rows)) / leaf)))
        order, ranges = np.arange(len(rows)), [(0, len(rows))]
        dense = np.zeros(width)
        for level in range(self.depth):
            for lo, hi in ranges[2**level - 1 :]:
                order[lo:hi] = order[lo:hi][self.halves(rows, order[lo:hi], dense)]
                middle = (lo + hi) // 2
                ranges += [(lo, middle), (middle, hi)]
        self.order, self.rows = order, rows.take(order)
        self.lo, self.hi = (np.array(x) for x in zip(*ranges))
        self.first_leaf = 2**self.depth - 1
        nodes: list[Sparse] = [None] * len(ranges)  # type: ignore[list-item]
        for v in range(len(ranges) - 1, -1, -1):
            if v >= self.first_leaf:
                below = self.rows.take(np.arange(self.lo[v], self.hi[v]))
            else:
                x, y = nodes[2 * v + 1], nodes[2 * v + 2]
                below = Sparse(x.begin, np.append(x.term, y.term), np.append(x.value, y.value))
            nodes[v] = below.maxima()
        self.nodes = Sparse(
            np.concatenate([[0], np.cumsum([len(x.term) for x in nodes])]),
            np.concatenate([x.term for x in nodes]),
            np.concatenate([x.value for x in nodes]),
        )

    @staticmethod
    def halves(rows: Sparse, own: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Order in which rows like one far row come first and those like another one last."""

        def alike(k: int) -> np.ndarray:
            a, b = rows.begin[own[k]], rows.begin[own[k] + 1]
            dense[rows.term[a:b]] = rows.value[a:b]
            out = rows.products(own, dense) / length
            dense[rows.term[a:b]] = 0
            return out / length[k]

        at, edge = rows.entries(own)
        length = np.sqrt(np.add.reduceat(rows.value[at].astype(float) ** 2, edge[:-1])) + 1e-9
        one = int(np.argmin(alike(0)))
        left = alike(one)
        return np.argsort(alike(int(np.argmin(left))) - left, kind="stable")


class Items:
    """Tree over the items, and the best documents so far of each."""

    def __init__(self, rows: Sparse, width: int, k: int, least: np.ndarray):
        self.tree, self.k, self.width = Tree(rows, width, leaf=4), k, width
        self.best: list[list] = [[] for _ in range(len(rows))]  # in the order of the tree's rows
        self.least = np.append(np.maximum(least[self.tree.order], 1), np.iinfo(np.int64).max)
        self.scored = 0

    def weakest(self, nodes: np.ndarray) -> np.ndarray:
        ends = np.stack([self.tree.lo[nodes], self.tree.hi[nodes]], axis=1).ravel()
        return np.minimum.reduceat(self.least, ends)[::2]

    def search(self, docs: Tree, ids: list) -> None:
        self.visit(docs, ids, 0, np.zeros(1, np.int64), np.zeros(self.width, np.int64))

    def visit(self, docs: Tree, ids: list, v: int, nodes: np.ndarray, dense: np.ndarray) -> None:
        """Compare document node v with item nodes; what is left goes on with the children of both."""
        a, b = docs.nodes.begin[v], docs.nodes.begin[v + 1]
        term = docs.nodes.term[a:b]
        dense[term] = docs.nodes.value[a:b]
        leaf = v >= docs.first_leaf
        while True:
            bound = self.tree.nodes.products(nodes, dense)
            nodes = nodes[bound >= self.weakest(nodes)]
            inner = nodes < self.tree.first_leaf
            if not len(nodes) or not inner.any():
                break
            nodes = np.concatenate([nodes[~inner], 2 * nodes[inner] + 1, 2 * nodes[inner] + 2])
            if not leaf:
                break
        if leaf and len(nodes):
            own = np.concatenate([np.arange(lo, hi) for lo, hi in zip(self.tree.lo[nodes], self.tree.hi[nodes])])
            own = own[self.tree.rows.products(own, dense) >= self.least[own]]
        dense[term] = 0
        if not len(nodes):
            return
        if not leaf:
            near = [docs.nodes.value[docs.nodes.begin[c] : docs.nodes.begin[c + 1]].sum() for c in (2 * v + 1, 2 * v + 2)]
            for c in (2 * v + 1, 2 * v + 2) if near[0] >= near[1] else (2 * v + 2, 2 * v + 1):
                self.visit(docs, ids, c, nodes, dense)
        elif len(own):
            self.score(docs, ids, int(docs.lo[v]), int(docs.hi[v]), own)

    def score(self, docs: Tree, ids: list, lo: int, hi: int, items: np.ndarray) -> None:
        """Exact scores of a leaf's documents for items (positions in the tree)."""
        a, b = docs.rows.begin[lo], docs.rows.begin[hi]
        columns, at = np.unique(docs.rows.term[a:b], return_inverse=True)
        place = np.full(self.width, len(columns), np.int32)
        place[columns] = np.arange(len(columns))
        dense = np.zeros((hi - lo, len(columns) + 1), np.int64)
        dense[np.repeat(np.arange(hi - lo), np.diff(docs.rows.begin[lo : hi + 1])), at] = docs.rows.value[a:b]
        entry, edge = self.tree.rows.entries(items)
        scores = np.add.reduceat(dense[:, place[self.tree.rows.term[entry]]] * self.tree.rows.value[entry], edge[:-1], axis=1)
        self.scored += scores.size
        doc, which = np.nonzero(scores >= self.least[items])
        for i in np.unique(which).tolist():
            item = int(items[i])
            best = self.best[item]
            for d in doc[which == i].tolist():
                name = ids[docs.order[lo + d]]
                best.append((-int(scores[d, i]), name is None, name or 0))
            best.sort()
            del best[self.k :]
            if len(best) == self.k:
                self.least[item] = max(self.least[item], -best[-1][0])

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for at, best in enumerate(self.best):
            for score, none, name in best:
                yield int(self.tree.order[at]), None if none else name, -score


def doc_trees(batches, total: int, docs: int, width: int):
    """(tree, doc_ids) of blocks of document vectors; a coordinate is a term's part of the score without its weight."""

    def trees():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        terms, counts = rows.column("terms"), rows.column("counts")
        begin = np.asarray(terms.offsets, np.int64)
        begin = begin - begin[0]
        length = np.array([10 + 90 * n * docs // total for n in rows.column("n").to_pylist()], np.int64)
        count = counts.flatten().to_numpy()
        value = 1_000_000_000 * count // (1000 * count + 8 * np.repeat(length, np.diff(begin)))
        return Tree(Sparse(begin, terms.flatten().to_numpy().astype(np.int64), value), width), rows.column("doc_id").to_pylist()

    held, size, entries = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            held.append(part)
            size, entries = size + part.num_rows, entries + len(part.column("terms").flatten())
            if size >= TREE_DOCS or entries >= TREE_TERMS:
                yield trees()
                held, size, entries = [], 0, 0
    if size:
        yield trees()


def search(found: DataFrame, rows: Sparse, total: int, docs: int, width: int, k: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): each task's best documents, those at or above the known k-th scores only."""

    def run(batches):
        items = None
        for tree, ids in doc_trees(batches, total, docs, width):
            items = items or Items(rows, width, k, least)
            items.search(tree, ids)
        hits = list(items.rows()) if items else []
        if hits:
            item, name, score = zip(*hits)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(name, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    own = found.where("kind = 0").select("doc_id", "n", "terms", "counts")
    return own.mapInArrow(run, HITS)


def best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_part(docs: DataFrame, ids: list, texts: list, k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of one part of the items; None if they have no terms."""
    spark = docs.sparkSession
    term, first = terms_of(pa.array(texts, pa.string()))
    vocabulary = np.unique(term)
    if not len(vocabulary):
        return None
    found = kept(vectors(docs, vocabulary), "vectors")
    facts = found.where("kind = 1")
    total, count = facts.agg(F.sum("n"), F.sum("docs")).first()
    if not total:
        return None
    held = facts.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for t, df in held.toLocalIterator():  # at most the terms of a part of the items
        weight[t] = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
    owner = np.repeat(np.arange(len(ids)), np.diff(first))
    code = np.unique(owner * len(vocabulary) + np.searchsorted(vocabulary, term))
    owner, which = np.divmod(code, len(vocabulary))
    good = weight[which] > 0
    owner, which = owner[good], which[good]
    names, begin = np.unique(owner, return_index=True)
    if not len(names):
        return None
    rows = Sparse(np.append(begin, len(owner)), which, weight[which])

    def hits(part: DataFrame, least: np.ndarray) -> DataFrame:
        return best_of(search(part, rows, total, count, len(vocabulary), k, least), k)

    least = np.zeros(len(rows), np.int64)
    share = found.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0)
    for r in hits(share, least).where(F.col("rank") == k).select("item", "score").collect():  # one row an item
        least[r["item"]] = r["score"]
    table = spark.createDataFrame([(k_, ids[i]) for k_, i in enumerate(names.tolist())], "item int, item_id long")
    out = hits(found, least).join(F.broadcast(table), "item")  # one row an item of the part
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, with scores above 0, best first.

    Equal scores come by ascending doc_id, a null doc_id last.  A null or empty text has no terms: such an item gets no
    rows, such a document is never found and does not count.  Repeated documents are ranked each; repeated
    rows of an item count once, and two texts under one item_id are ranked apart.  Empty tables give no rows.  Other columns are
    left out.  Items are taken in parts of bounded length, with one pass over the texts for each part.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for ids, texts in item_parts(benchmark.select("item_id", "text").distinct()):
        part = rank_part(docs, ids, texts, k)
        if part is not None:
            out = out.union(part)
    return out
