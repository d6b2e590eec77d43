"""Token ids of whole texts with the tokenizers library.

A tokenizer that drops white space never joins characters across white space, so the ids of a text
are the ids of its white-space-separated pieces, in order, and those of a Latin word with
closing signs are the ids of both parts.  Words recur, so each Python worker keeps the ids
of the words it met (bounded stores) and asks the library for new ones only.
``splits_at_space`` reads from a tokenizer file whether that holds; otherwise whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

#: Pieces and bare words that a worker remembers; a store is emptied when it is full.
REMEMBERED_PIECES = 900_000
REMEMBERED_WORDS = 700_000
#: White space on which Python and the tokenizer may differ; a text that has any is encoded whole.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: A Latin word with closing signs but no apostrophe: the tokenizer cuts between the two.
WORD_AND_SIGNS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z")

#: Fixed value: the pattern of a tokenizer that cuts words like this and drops white space.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_open: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.by_piece = splits_at_space(path)
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values()), bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return [self.whole(t or "") for t in texts]
        cut = [None if t and ODD_SPACE.search(t) else (t or "").split() for t in texts]
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces.clear()
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        known = self.pieces
        new = {p for pieces in cut if pieces for p in pieces if p not in known}
        parts = {p: (m[1].lower(), m[2]) for p in new if (m := WORD_AND_SIGNS.match(p))}
        self.learn({word for word, _ in parts.values()}, {signs for _, signs in parts.values() if signs})
        words = self.words
        for p, (word, signs) in parts.items():
            known[p] = words[word] + words[signs] if signs else words[word]
        for p in new - parts.keys():
            known[p] = self.whole(p)
        find = known.__getitem__
        return [self.whole(t) if pieces is None else b"".join(map(find, pieces)) for t, pieces in zip(texts, cut)]

    def learn(self, bare: set[str], other: set[str]) -> None:
        """Ask the library for words met first; bare ones, a merge run each, go in as long texts."""
        new = [w for w in bare if w not in self.words]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            texts = [" ".join(part[k : k + 200]) for k in range(0, len(part), 200)]
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            cut = (np.flatnonzero(self.closes[ids]) + 1) * 4
            raw, begin = ids.tobytes(), 0
            if len(cut) != len(part):
                raise ValueError("a bare word was cut into several runs of merges")
            for w, end in zip(part, cut.tolist()):
                self.words[w] = raw[begin:end]
                begin = end
        for w in other:
            if w not in self.words:
                self.words[w] = self.whole(w)


def splits_at_space(path: str) -> bool:
    """True if white space is turned into one space and then dropped before any merge."""
    with open(path, encoding="utf-8") as f:
        head = json.load(f)
    pre = head.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return drops and pattern == CUTS and head["model"].get("end_of_word_suffix") == "</w>"


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def encode(path: str, column: pa.Array) -> list[bytes]:
    return encoder(path).encode(column.to_pylist())
