"""MinHash near duplicates with sequential Bayesian verification.

1. One pass gives every text its distinct shingles' count, a hash of the set, band hashes of a MinHash
   signature, and further signature rows of 8 bits for comparison.  Equal sets are one class from here on.
2. Sets with a common band are candidates.  The number of bands follows from the chosen miss probability.
3. Candidates are compared in stars (``stars.star_rounds``): a band's leader with the others, then outsiders with the rest.
   A pair's signature rows are compared batch after batch.  With m of n rows equal, the chance that two rows are equal
   has a Beta(m + 1, n - m + 1) posterior; the pair is dropped as soon as the posterior probability of reaching the
   threshold is under the miss probability.
4. Survivors are verified on their whole sets.  Lists that are still open after the star rounds are dealt in blocks, and
   the pairs of each block are compared and verified in place, so that only links become rows.  There, shingles that no other open set
   has bound the overlap first: a copy that is too far from its original is too far from the other copies as well.

Bands and comparison rows come from different hash functions, so having met does not favour a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import words
from wavemill.llm.shared import kept, lists, one_by_one
from wavemill.llm.stars import alone, in_blocks, joined, members_of, named_by_smallest, overlaps, star_rounds, texts_of

#: Signature rows of a band.
ROWS = 5
#: Signature rows that are compared, and how many at once.
CHECKS = 192
BATCH = 32
#: Star rounds before the rest is compared in blocks.
ROUNDS = 3


def bands_for(threshold: float, miss: float, rows: int = ROWS) -> int:
    """Bands for which a pair at the threshold meets nowhere with at most the miss probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_equal(threshold: float, miss: float, checks: int = CHECKS, batch: int = BATCH) -> np.ndarray:
    """For each batch: the equal rows so far that a pair needs to go on.

    With a uniform prior, P(p >= t | m of n) = P(Binomial(n + 1, t) <= m).  Rows of 8 bits are also equal by accident,
    so t is the threshold raised by that chance.
    """
    t = threshold + (1 - threshold) / 256
    need = []
    for n in range(batch, checks + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        need.append(m)
    return np.array(need)


def signatures(values: np.ndarray, begin: np.ndarray, rows: int) -> np.ndarray:
    """Signature rows (rows x sets) of non-empty sets: minima of 32-bit permutations of the shingle hashes."""
    rng = np.random.Generator(np.random.PCG64(20))
    flip = rng.integers(0, 1 << 32, rows, np.uint64).astype(np.uint32)
    times = rng.integers(0, 1 << 32, rows, np.uint64).astype(np.uint32) | np.uint32(1)
    own = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((rows, len(begin) - 1), np.uint32)
    if len(begin) > 1:
        held = np.empty_like(own)
        for k in range(rows):
            np.bitwise_xor(own, flip[k], out=held)
            np.multiply(held, times[k], out=held)
            np.minimum.reduceat(held, begin[:-1], out=out[k])
    return out


def set_hash(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set, whatever the order of its shingles."""
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words.mix(values, 21), out=total[1:])
        sums = total[begin[1:]] - total[begin[:-1]] + np.diff(begin).astype(np.uint64)
    return words.mix(sums, 22).view(np.int64)


def sketched(rows: DataFrame, n: int, bands: int) -> DataFrame:
    """(doc_id, tag, n, set, bands, checks) of every row."""

    def sketch(values, begin):
        sizes = np.diff(begin)
        some = np.flatnonzero(sizes)
        sign = signatures(values, np.append(begin[some], begin[-1]), bands * ROWS + CHECKS)
        keys = np.zeros((len(some), bands), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(bands):
                acc = np.full(len(some), k, np.uint64)
                for row in sign[k * ROWS : (k + 1) * ROWS]:
                    acc = words.mix(acc ^ row.astype(np.uint64), 23)
                keys[:, k] = acc
            low = ((sign[bands * ROWS :] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        at = np.zeros(len(sizes) + 1, np.int64)
        at[1:] = np.cumsum((sizes > 0) * bands)
        raw = pa.py_buffer(np.ascontiguousarray(low.T).tobytes())
        ends = np.zeros(len(sizes) + 1, np.int32)
        ends[1:] = np.cumsum((sizes > 0) * CHECKS)
        checks = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), raw])
        cols = [pa.array(sizes), pa.array(set_hash(values, begin)), lists(keys.ravel().view(np.int64), at, pa.int64()), checks]
        return cols, ["n", "set", "bands", "checks"]

    return members_of(rows, n, sketch, "n long, set long, bands array<long>, checks binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Comparison rows of a batch, a row for each set."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return raw.reshape(len(column), -1)


def plausible(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Positions of pairs (rows of x and y) that no batch rules out; each batch looks at those left only."""
    left = np.arange(len(x))
    equal = np.zeros(len(x), np.int64)
    for k, least in enumerate(need.tolist()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (x[left, part] == y[left, part]).sum(axis=1)
        good = equal >= least
        left, equal = left[good], equal[good]
        if not len(left):
            break
    return left


def survivors(pairs: DataFrame, sets: DataFrame, need: np.ndarray) -> DataFrame:
    """Pairs (a, b) that the signature rows don't rule out."""
    checks = sets.select("set", "checks")
    both = pairs.select("a", "b").join(checks.select(F.col("set").alias("a"), F.col("checks").alias("x")), "a")
    both = both.join(checks.select(F.col("set").alias("b"), F.col("checks").alias("y")), "b").select("a", "b", "x", "y")

    def build(batch):
        good = plausible(matrix(batch.column("x")), matrix(batch.column("y")), need)
        yield batch.select(["a", "b"]).take(pa.array(good))

    return one_by_one(both, build, "a long, b long")


def narrowing(need: np.ndarray, threshold: tuple[int, int]):
    """Pairs of a block that sizes, shingles of one's own and signature rows leave."""
    top, bottom = threshold

    def narrow(batch: pa.RecordBatch, k: int, others: np.ndarray) -> np.ndarray:
        size, component, own = (batch.column(c).to_numpy() for c in ("size", "component", "alone"))
        rows = matrix(batch.column("checks"))
        most = np.minimum(size[k] - own[k], size[others] - own[others])  # the overlap that the two can have
        meet = (component[others] != component[k]) & (most * bottom >= (size[k] + size[others] - most) * top)
        at = others[meet]
        return at[plausible(np.broadcast_to(rows[k], (len(at), rows.shape[1])), rows[at], need)]

    return narrow


def near_duplicates(docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (80, 100), miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows are linked if intersection / union of their sets of ``n``-word shingles reaches ``threshold``; links are
    confirmed on the whole sets.  ``miss`` is the chance of a pair at the threshold to share no band, and the posterior
    probability under which a pair is dropped.  component_id is the smallest doc_id that links reach; kept is doc_id = component_id.
    A text with fewer than ``n`` words has its whole sequence as one shingle; null texts and texts without words have
    none, are linked with nothing and are kept.  Repeated rows stay, all in one component.  A row without doc_id can carry links
    but names no component unless all of the component is without, whose rows are all kept.  Other columns are left out.
    """
    top, bottom = threshold
    share = top / bottom
    bands, need = bands_for(share, miss), least_equal(share, miss)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = kept(sketched(rows, n, bands), "signatures")
    members = sketch.select("doc_id", "tag", "n", "set")
    sets = kept(sketch.where("n > 0").select("set", "n", "bands", "checks").dropDuplicates(["set"]), "sets")

    keys = sets.select("set", F.col("n").alias("size"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("of")).where("of > 1").select("key")
    listed = keys.join(shared, "key")
    listed = kept(listed.join(listed.groupBy("set").agg(F.count("*").alias("weight")), "set"), "lists")
    texts = kept(texts_of(rows, members, listed.select("set").distinct()), "texts")

    def compare(pairs: DataFrame) -> DataFrame:
        close = F.least("size_a", "size_b") * bottom >= F.greatest("size_a", "size_b") * top
        found = overlaps(kept(survivors(pairs.where(close), sets, need), "pairs"), texts, n)
        return found.where(F.col("common") * bottom >= F.col("either") * top).select("a", "b")

    reached, left = star_rounds(listed, compare, ROUNDS)
    if not left.isEmpty():
        single = alone(left.select("set").distinct(), texts, n)
        open_sets = sets.select("set", "checks").join(single, "set", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        found = in_blocks(left.drop("weight").join(open_sets, "set"), texts, n, threshold, narrowing(need, threshold))
        reached = joined(reached, found)
    out = named_by_smallest(members, reached)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
