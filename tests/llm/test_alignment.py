"""Cross-tokenizer alignment against both libraries and plain counting."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wavemill.llm import align, pairs, queries  # noqa: F401

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = align.byte_alphabet()
    bytes_a = {i: bytes(alphabet[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if t != "<|endoftext|>"}

    def cut(text):
        """([(id, bytes)], [(id, bytes)]) by the libraries named in the contract."""
        x = [(i, bytes_a[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        return x, y

    return cut


def ends(tokens):
    at, out = 0, []
    for _, t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain(rows, cut):
    """{place: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)}"""
    found, count = [], Counter()
    for doc_id, text in rows:
        x, y = cut(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            x, y = [], []
        ex, ey = ends(x), ends(y)
        at = dict(zip(ey, (j for j, _ in y)))
        links = [(i, at[p]) for (i, _), p in zip(x, ex) if p in at]
        groups, i, j = [], 0, 0
        for high in sorted(set(ex) & set(ey)):
            sides = []
            for ids, stops, k in ((x, ex, i), (y, ey, j)):
                own = k
                while own < len(ids) and stops[own] <= high:
                    own += 1
                sides.append(",".join(str(n) for n, _ in ids[k:own]))
                i, j = (own, j) if ids is x else (i, own)
            groups.append("|".join(sides))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        count.update(links)
        found.append((doc_id, len(x), len(y), len(groups), links, sha))
    top = Counter()
    for (_, j), c in count.items():
        top[j] = max(top[j], c)
    return sorted(((d, a, b, g, len(p), sum(count[x] == top[x[1]] for x in p), sum(count[x] for x in p), s) for d, a, b, g, p, s in found), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["  two  spaces ", "▁ mark", "tab\tnew\n\nline \r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "éè 漢字 \U0001f600 ‍", "\x00 nul", "it's 1234567 'quoted'", "a" * 3000, "ﬁ   x", " ", "\n"]


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_like_the_libraries(docs_of, sample, libraries):
    rows = [(r["doc_id"], r["text"]) for r in sample.limit(60).collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, None), (None, "of the"), (7, ""), (8, "of the"), (8, "of the")]
    rows.append((9, " ".join(rows[k % 50][1] for k in range(300))[:200_000]))
    docs = docs_of(rows).withColumn("document", F.lit("x")).withColumn("kind", F.lit(1)).withColumn("blob", F.lit(2)).repartition(5)
    assert got(align.alignment(docs, A, B)) == plain(rows, libraries)
    assert align.alignment(docs_of([]), A, B).count() == 0


def test_many_runs_blocks_and_merges(docs_of, sample, libraries, monkeypatch):
    for name, value in (("RUN", 900), ("BLOCK", 64), ("FAN_IN", 3), ("STREAM", 2)):
        monkeypatch.setattr(pairs, name, value)
    rows = [(r["doc_id"], (r["text"] or "")[:1500]) for r in sample.limit(60).collect()]
    assert got(align.alignment(docs_of(rows).repartition(7), A, B)) == plain(rows, libraries)


def test_merge_is_complete_in_any_cut():
    rng = random.Random(2)
    want, blocks = Counter(), []
    for _ in range(30):
        code = np.sort(np.array([rng.randrange(500) << 16 | rng.randrange(3) for _ in range(rng.randint(1, 80))]))
        code, n = pairs.summed(code, np.ones(len(code), np.int64))
        want.update(dict(zip(code.tolist(), n.tolist())))
        blocks.append((code, n))
    merge, out = pairs.Merge(), []
    for code, n in sorted(blocks, key=lambda x: x[0][0]):
        out.append(merge.below(int(code[0])))
        merge.push(code, n)
        merge.settle()
    out.append(merge.below(1 << 62))
    code, n = (np.concatenate(x) for x in zip(*out))
    assert (np.diff(code) > 0).all() and dict(zip(code.tolist(), n.tolist())) == dict(want)


def test_blocks_round_trip():
    code = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 5000))
    other = np.random.default_rng(2).integers(0, 1 << 50, 5000)
    assert all((x == y).all() for x, y in zip(pairs.unpacked(pairs.packed(code, other), 2), (code, other)))


def test_both_byte_level_libraries_agree_on_all_characters():
    """The vocabulary file is read as ranks; every code point, beside letters, digits, signs and spaces, is cut the same."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    own = align.aligner(A, B).a
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    texts = [" ".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)} .{chr(c)}." for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    assert [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)] == [own.encode_ordinary(t) for t in texts]


def test_query_is_registered(spark, libraries):
    from wavemill.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(QUERIES["op11_token_alignment"](spark, folder)) == plain(rows, libraries)
