"""Dual-tree search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import LOWER
from wavemill.llm import dualtree, queries  # noqa: F401

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """[(item_id, rank, doc_id, score)]"""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for i, text in sorted(set(items), key=str):
        found = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:k], 1):
            out.append((i, rank, None if none else d, -score))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def small_trees(monkeypatch):
    monkeypatch.setattr(dualtree, "TREE_DOCS", 600)


def corpus(rng, n=900):
    common, rare = [f"c{k}" for k in range(30)], [f"r{k}É" for k in range(500)]
    docs = [(k, " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.choice([0, 3, 20, 60, 200])))) for k in range(n)]
    items = [(k, " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 25)))) for k in range(40)]
    docs += [(n + k, items[k % 7][1] + ", " + " ".join(rng.choices(common, k=k))) for k in range(40)]
    return docs, items


def test_like_scoring_everything(spark, docs_of, small_trees):
    docs, items = corpus(random.Random(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(dualtree.ranked(docs_of(docs), bench)) == plain(docs, items)
    assert got(dualtree.ranked(docs_of(docs), bench, k=3)) == plain(docs, items, 3)


def test_ties_odd_rows_and_extra_columns(spark, docs_of):
    docs = [(None, "tie word"), (5, "tie word"), (3, "tie word"), (3, "tie word"), (9, None), (10, ""), (11, "?! ,,"), (12, "Größe x-y_z 7a"), (13, "tie " * 30_000)]
    items = [(1, "tie"), (1, "word"), (2, None), (3, ""), (4, "größe GRÖßE"), (5, "y"), (5, "y"), (6, "nowhere"), (7, "7A")]
    frame = docs_of(docs).withColumn("item_id", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("score", F.lit(2))
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    assert got(dualtree.ranked(frame, bench)) == plain(docs, items)
    assert dualtree.ranked(docs_of([]), bench).count() == 0
    assert dualtree.ranked(frame, bench.limit(0)).count() == 0


def test_whole_batches_are_pruned_without_loss():
    """Documents of one item's kind are never scored for the others."""
    rng = random.Random(1)
    rows = [sorted({8 * g + rng.randrange(8) for _ in range(6)}) for g in range(16) for _ in range(64)]
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    docs = dualtree.Sparse(begin, np.array([t for r in rows for t in r]), np.array([rng.randint(1, 1000) for r in rows for _ in r]))
    need = [list(range(8 * g, 8 * g + 8)) for g in range(16)]
    items = dualtree.Sparse(np.arange(17) * 8, np.array(sum(need, [])), np.array([rng.randint(1, 50) for _ in range(128)]))
    order = rng.sample(range(len(rows)), len(rows))
    docs = docs.take(np.array(order))
    search = dualtree.Items(items, 128, 5, np.zeros(16, np.int64))
    search.search(dualtree.Tree(docs, 128), list(range(len(rows))))
    want = []
    dense = np.zeros((16, 128), np.int64)
    dense[np.repeat(np.arange(16), 8), items.term] = items.value
    scores = np.stack([np.add.reduceat(dense[i, docs.term] * docs.value, docs.begin[:-1]) for i in range(16)])
    for i in range(16):
        best = sorted((-int(s), d) for d, s in enumerate(scores[i]) if s > 0)[:5]
        want += [(i, d, -s) for s, d in best]
    assert sorted(search.rows()) == sorted(want)
    assert search.scored < 0.25 * scores.size


def test_bounds_hold_for_every_node():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 200)
    rows = [np.sort(rng.choice(50, s, replace=False)) for s in sizes]
    sparse = dualtree.Sparse(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(rows), rng.integers(1, 99, sizes.sum()))
    tree = dualtree.Tree(sparse, 50)
    assert sorted(tree.order.tolist()) == list(range(200))
    whole = np.zeros((200, 50), np.int64)
    for k, (a, b) in enumerate(zip(tree.rows.begin[:-1], tree.rows.begin[1:])):
        whole[k, tree.rows.term[a:b]] = tree.rows.value[a:b]
    for v in range(len(tree.nodes)):
        most = np.zeros(50, np.int64)
        a, b = tree.nodes.begin[v], tree.nodes.begin[v + 1]
        most[tree.nodes.term[a:b]] = tree.nodes.value[a:b]
        assert (most == whole[tree.lo[v] : tree.hi[v]].max(axis=0)).all()


def test_query_is_registered_and_like_scoring_everything(spark):
    from wavemill.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(QUERIES["op13_dual_tree_search"](spark, folder)) == plain(docs, items)
