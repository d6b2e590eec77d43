"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from fractions import Fraction

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, n=5):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def jaccard_components(rows, threshold=Fraction(80, 100), n=5):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                if len(x & y) >= threshold * len(x | y):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def template_drops(rows, depth=3, least_documents=3, least_tokens=5, least_constant=0.7):
    """{doc_id: kept text} by the rules of line dedup, for distinct doc_ids."""
    from collections import Counter, defaultdict

    lines = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            tok = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(tok) >= least_tokens:
                leaf = (len(tok), tuple("<*>" if re.search("[0-9]", x) else x for x in tok[:depth]))
                lines.append((d, k, leaf, tuple(tok), line))
    in_leaf = Counter(x[2] for x in lines)
    lines = [x for x in lines if in_leaf[x[2]] >= least_documents]
    support = Counter((x[2], i, w) for x in lines for i, w in enumerate(x[3]) if i >= depth)
    found = defaultdict(list)
    for d, k, leaf, tok, _ in lines:
        kept = tuple((i, w) for i, w in enumerate(tok) if i >= depth and support[leaf, i, w] >= least_documents)
        if len(kept) >= (len(tok) - depth) * least_constant:
            found[leaf, kept].append((d, k))
    drop = defaultdict(set)
    for places in found.values():
        if len({d for d, _ in places}) >= least_documents:
            for d, k in sorted(places)[1:]:
                drop[d].add(k)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d]) for d, t in rows}


def best_window(text, item, n=5):
    """Largest weighted shingle similarity of an item-sized window of a text with an item."""
    from collections import Counter

    own, item = words_of(text), words_of(item)

    def weigh(w):
        return Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter()

    want, best = weigh(item), 0.0
    for s in range(max(1, len(own) - len(item) + 1)):
        got = weigh(own[s : s + len(item)])
        either = sum((want | got).values())
        best = max(best, sum((want & got).values()) / either if either else 0.0)
    return best
