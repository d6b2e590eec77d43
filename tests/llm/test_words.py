import random

import numpy as np
import pyarrow as pa

from tests.llm.brute import shingle_set, words_of
from wavemill.llm import words

TEXTS = ["", None, " ", "a", "A b\tc\nd  e f", "x" * 50, "é É ß\x0bÀ A\x85b", "a b c d e", "one two three four five six one two three four five"]


def test_words_and_shingles_like_plain_ones():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab AB é longwordofmanyletters".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    h, first = words.words(pa.array(texts, pa.string()))
    names = {}
    for k, t in enumerate(texts):
        own = words_of(t)
        assert len(own) == first[k + 1] - first[k]
        for w, x in zip(own, h[first[k] : first[k + 1]].tolist()):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    values, counts, begin = words.distinct(*words.shingles(h, first, 5))
    assert [len(shingle_set(t)) for t in texts] == np.diff(begin).tolist()
    assert counts.sum() == sum(max(0, len(words_of(t)) - 4) if len(words_of(t)) >= 5 else bool(words_of(t)) for t in texts)


def test_sliced_batches_and_empty_columns():
    column = pa.array(TEXTS, pa.string())
    h, first = words.words(column)
    g, second = words.words(column.slice(4, 3))
    assert g.tolist() == h[first[4] : first[7]].tolist() and second[0] == 0
    assert len(words.words(pa.array([], pa.string()))[0]) == 0
    batch = pa.record_batch({"text": column})
    assert sum(p.num_rows for p in words.pieces(batch, "text", 4)) == len(TEXTS)
