"""MinHash near duplicates against all pairs."""

import random
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import jaccard_components
from tests.llm.test_text_operators import ODD, near_copies
from wavemill.llm import minhash, stars


def groups_of(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(docs_of, seed):
    rows = near_copies(random.Random(seed))
    assert groups_of(minhash.near_duplicates(docs_of(rows))) == jaccard_components(rows, n=4)


def crowd():
    """A passage that many texts share, copies that are near their original only, and a chain."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(passage + [f"x{k}_{j}" for j in range(rng.randint(0, 18))])) for k in range(50)]
    base = [f"c{k}" for k in range(160)]
    for k in range(40):
        own = list(base)
        for j in rng.sample(range(160), rng.randint(2, 7)):
            own[j] = f"e{rng.randrange(6)}"
        rows.append((100 + k, " ".join(own)))
    for k in range(12):
        rows.append((200 + k, " ".join([f"d{j}" for j in range(k * 6)] + [f"f{j}" for j in range(k * 6, 100)])))
    rows += [(300 + k, "a very long text " + " ".join(f"l{j}" for j in range(30_000 + k))) for k in range(2)]
    return rows


@pytest.mark.parametrize("rounds", [1, 3])
def test_crowded_lists(docs_of, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(stars, "BLOCK", 7)  # many blocks
    rows = crowd()
    assert groups_of(minhash.near_duplicates(docs_of(rows))) == jaccard_components(rows, n=4)


def test_odd_rows(docs_of):
    docs = docs_of(ODD + [(4, "word"), (None, None), (None, "word")])
    for name in ("set", "key", "tag", "text_", "component", "size", "weight"):
        docs = docs.withColumn(name, F.lit("x"))
    out = minhash.near_duplicates(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == len(ODD) + 3
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in out.collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True) and got[None, 0] == (None, True)
    assert got[4, 1] == (4, True) and got[5, 1] == (4, False) and got[None, 1] == (4, False) and got[6, 1] == (6, True)
    assert got[7, 2] == (7, True) and got[8, 2] == (7, False) and got[None, 3] == (None, True)
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_posterior_bound():
    need = minhash.least_equal(0.8, 1e-7)
    t = 0.8 + 0.2 / 256
    for k, m in enumerate(need.tolist(), 1):
        n = k * minhash.BATCH
        grid = (np.arange(200_000) + 0.5) / 200_000  # the Beta density, integrated on a grid

        def above(equal):
            with np.errstate(under="ignore"):
                density = grid**equal * (1 - grid) ** (n - equal) * comb(n, equal) * (n + 1)
            return density[grid >= t].mean() * (1 - t)

        assert above(m) >= 0.9e-7 and (m == 0 or above(m - 1) < 1.1e-7)
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(0.8, 1e-7) <= 1e-7


def test_signature_rows_agree_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 3000, np.int64).astype(np.uint64)
    both = np.concatenate([values[:2000], values[1000:]])
    sign = minhash.signatures(both, np.array([0, 2000, 4000]), 2000)
    assert abs((sign[:, 0] == sign[:, 1]).mean() - 1 / 3) < 0.05


def test_query_is_registered_and_like_all_pairs(spark):
    from wavemill.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert groups_of(QUERIES["op12_bayes_minhash"](spark, folder)) == jaccard_components(rows, n=4)
