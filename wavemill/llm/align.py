"""Alignment of the tokens of two tokenizers, with corpus-wide counts of the linked id pairs.

Both tokenizers cut space + text.  Byte offsets at which a token of each ends cut the tokens into groups; the two tokens that end
there are linked.  One pass encodes and aligns; ``pairs`` counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import pairs, words
from wavemill.llm.shared import kept

#: Fixed value: how byte-level tokenizers cut texts before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are aligned at once; a longer text goes by itself.
PIECE = 1 << 20

ALIGNED = "kind int, document long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, radix int, run long, first long, blob binary"

_open: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Bytes:
    """Bytes of each token id, end to end, and the decimal digits of ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits of 0 to n - 1, to the right, and how many each has."""
    width = len(str(n))
    value = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    return (value % 10 + ord("0")).astype(np.uint8), np.maximum(1, (value > 0).sum(axis=1))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model = spec["pre_tokenizer"], spec["model"]
        vocabulary, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or made != sorted(made) or model.get("ignore_merges"):
            raise ValueError("tokenizer A is not a byte-level one with merges in the order of their ids")
        alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        tokens = [b""] * (1 + max(ranks.values()))
        for t, i in ranks.items():
            tokens[i] = t
        self.a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = Bytes(tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])
        self.digits, self.n_digits = digits(max(len(tokens), len(pieces)))
        if max(len(tokens), len(pieces)) > 1 << pairs.MINOR:
            raise ValueError("ids need more than 16 bits")

    def tokens(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's number of them."""
        count = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count

    def align(self, texts: list[str | None]):
        """Numbers and hashes for each text, and links (text, a, b) of all of them."""
        asked = [" " + t if t else "" for t in texts]
        raw = [x.encode() for x in asked]
        size = np.array([len(x) for x in raw], np.int64)
        a, n_a = self.tokens([self.a.encode_ordinary(x) if x else [] for x in asked])
        b, n_b = self.tokens(self.b.encode([t or "" for t in texts], num_threads=1))
        good = size > 0
        for table, ids, n in ((self.bytes_a, a, n_a), (self.bytes_b, b, n_b)):
            good &= per_text(table.size[ids], n) == size
        a, n_a, b, n_b = only(a, n_a, good), n_a * good, only(b, n_b, good), n_b * good
        if len(a):
            want = np.frombuffer(b"".join(x for x, g in zip(raw, good) if g), np.uint8)
            owner = np.repeat(np.flatnonzero(good), size[good])
            wrong = np.zeros(len(texts), bool)
            for table, ids in ((self.bytes_a, a), (self.bytes_b, b)):
                wrong[owner[table.joined(ids, np.cumsum(table.size[ids])) != want]] = True
            if wrong.any():
                good &= ~wrong
                a, n_a, b, n_b = only(a, n_a, good), n_a * good, only(b, n_b, good), n_b * good
        ends_a, ends_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        mark = np.zeros((2, (ends_a[-1] if len(a) else 0) + 1), bool)
        mark[0, ends_a] = True
        mark[1, ends_b] = True
        last_a, last_b = mark[1, ends_a], mark[0, ends_b]
        text_b = np.repeat(np.arange(len(texts)), n_b)
        links = text_b[last_b], a[last_a], b[last_b]
        n_groups = np.bincount(links[0], minlength=len(texts))
        return n_a, n_b, n_groups, self.digests(a, n_a, last_a, b, n_b, last_b), links

    def digests(self, a, n_a, last_a, b, n_b, last_b) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text, '' without tokens; all strings are laid out at once."""
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens of each side up to each group's end
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        place_a = np.arange(len(a)) + np.append(0, stop_b)[group_a]
        place_b = np.arange(len(b)) + stop_a[group_b]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[place_a], ids[place_b] = a, b
        sign[place_a], sign[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        total = n_a + n_b
        end = np.cumsum(total)
        sign[end[total > 0] - 1] = 0
        width = self.digits.shape[1]
        grid = np.empty((len(ids), width + 1), np.uint8)
        grid[:, :width], grid[:, width] = self.digits[ids], sign
        shown = np.arange(width + 1) >= width - self.n_digits[ids][:, None]
        shown[:, width] = sign > 0
        length = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
        flat, edge = memoryview(grid[shown]), length[np.append(0, end)].tolist()
        return [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:])]


def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.concatenate([[0], np.cumsum(n)])
    return total[edge[1:]] - total[edge[:-1]]


def only(ids: np.ndarray, n: np.ndarray, good: np.ndarray) -> np.ndarray:
    return ids if good.all() else ids[np.repeat(good, n)]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two tokenizer files."""
    if (path_a, path_b) not in _open:
        _open[path_a, path_b] = Aligner(path_a, path_b)
    return _open[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of kinds 0 (a document) and 1, 2 (blocks of pair-document records and their sums)."""
    names = [part.split()[0] for part in ALIGNED.split(", ")]
    kinds = {"kind": pa.int32(), "radix": pa.int32(), "groups_sha256": pa.string(), "blob": pa.binary()}

    def rows(size, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in names], names=names)

    def spilled(blocks):
        for kind, radix, run, first, blob in blocks:
            yield rows(1, kind=pa.array([kind], pa.int32()), radix=pa.array([radix], pa.int32()), run=pa.array([run]), first=pa.array([first]), blob=pa.array([blob], pa.binary()))

    def run(batches):
        both = aligner(path_a, path_b)
        task = TaskContext.get().partitionId()
        runs, seen = pairs.Runs(task), 0
        for batch in batches:
            for part in words.pieces(batch, "text", PIECE):
                n_a, n_b, n_groups, digest, (text, a, b) = both.align(part.column("text").to_pylist())
                document = np.arange(part.num_rows) + seen + (task << 40)
                seen += part.num_rows
                key, n = np.unique(text << 32 | b << pairs.MINOR | a, return_counts=True)
                yield from spilled(runs.add(key & 0xFFFFFFFF, document[key >> 32], n))
                yield rows(
                    part.num_rows,
                    kind=pa.array(np.zeros(part.num_rows, np.int32)),
                    document=pa.array(document),
                    doc_id=part.column("doc_id"),
                    n_a=pa.array(n_a),
                    n_b=pa.array(n_b),
                    n_groups=pa.array(n_groups),
                    groups_sha256=pa.array(digest, pa.string()),
                )
        yield from spilled(runs.spill())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is a byte-level tokenizer file with merges in the order of ids, B a sentencepiece model that adds a space; strings of special tokens are
    plain text.  n_links counts links (each group ends with one), count_sum their pairs' corpus-wide counts, and n_best
    those links whose count no other pair with the same B id exceeds.  A null or empty text, and one whose tokens' bytes differ
    from space + text, has no tokens: zeros and ''.  Repeated rows count each; an empty table gives no rows; other columns are left out.
    """
    found = kept(aligned(docs, path_a, path_b), "aligned")
    back = pairs.contributions(found, pairs.counts(found))
    out = found.where("kind = 0").join(back, "document", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
