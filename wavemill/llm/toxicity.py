"""Toxicity by non-negative positive-unlabelled learning with numpy classifiers.

Confirmed toxic texts are positive, a sample of the labelled texts with their labels hidden is
unlabelled.  With a class prior p, positives P and unlabelled U the risk of a classifier is

    p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)])

where the second term, the risk on negatives, cannot fall below zero: a batch that makes it
negative gives no gradient there and only the positive term counts.  The margin that the prior's share
of the unlabelled texts exceeds becomes the zero point.  Several classifiers with their own order of
batches are trained, one Spark task each; a score is the mean of their probabilities.

Inputs of a score are the words of the whole text only: each word, and its first four and five
bytes, present or not, hashed to ``BUCKETS`` places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm import words
from wavemill.llm.shared import lists, one_by_one

BUCKETS = 1 << 19
#: Most texts of each kind to learn from; texts are taken in order of a hash of doc_id.
MOST_POSITIVE, MOST_UNLABELLED = 5_000, 16_000
MEMBERS, EPOCHS, BATCH, RATE = 3, 4, 256, 0.3
#: A feature is learned if this many positive texts have it, beyond chance by this many deviations.
LEAST_POSITIVE, LEAST_SIGMA, LEAST_LIFT = 3, 1.0, 2.0
#: Letters, digits and all bytes of longer UTF-8 characters make words.
GAP = np.ones(256, bool)
for _part in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    GAP[list(_part)] = False

SCORES = "doc_id long, held_out boolean, score double, predicted int"


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct features of each text end to end, and where each text's begin."""
    raw, offsets = words.buffers(column)
    starts, ends, first = words.spans(raw, offsets, GAP)
    kinds = [words.hashes(raw, starts, ends)]
    kinds += [words.mix(words.hashes(raw, starts, np.minimum(ends, starts + k)), k) for k in (4, 5)]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    every = (np.stack(kinds, 1).ravel() >> shift)
    values, _, begin = words.distinct(every, first * 3)
    return values.astype(np.int64), begin


def margins(values: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[values], dtype=np.float64)])
    return total[begin[1:]] - total[begin[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def rows_of(values: np.ndarray, begin: np.ndarray, take: np.ndarray):
    n = begin[take + 1] - begin[take]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin[take], n)
    return values[at], np.concatenate([[0], np.cumsum(n)])


def telling(values: np.ndarray, begin: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Features to learn from: clearly more frequent among positive than among unlabelled texts.

    A feature of toxic texts alone has a lift of one over the class prior, one that has nothing to
    do with toxicity has a lift of one; rare features of single texts would only be memorised.
    """
    own = np.repeat(positive, np.diff(begin))
    p = np.bincount(values[own], minlength=BUCKETS)
    u = np.bincount(values[~own], minlength=BUCKETS)
    sure = np.maximum(0, p - LEAST_SIGMA * np.sqrt(p)) / max(1, positive.sum())
    return (p >= LEAST_POSITIVE) & (sure > LEAST_LIFT * u / max(1, (~positive).sum()))


def train(values: np.ndarray, begin: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Weights of one classifier, the bias last; AdaGrad steps on the non-negative risk."""
    draw = np.random.default_rng(seed)
    w = np.zeros(BUCKETS + 1)
    w[-1] = np.log(prior / (1 - prior))
    size = np.full(BUCKETS + 1, 1e-2)
    use = np.append(telling(values, begin, positive), True)
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    steps = EPOCHS * max(1, -(-len(unl) // BATCH), -(-len(pos) // BATCH))
    for _ in range(steps):
        p, u = draw.choice(pos, min(BATCH, len(pos)), False), draw.choice(unl, min(BATCH, len(unl)), False)
        vp, bp = rows_of(values, begin, p)
        vu, bu = rows_of(values, begin, u)
        zp, zu = margins(vp, bp, w) + w[-1], margins(vu, bu, w) + w[-1]
        # Logistic loss: of + it is log(1 + exp(-z)), of - it is log(1 + exp(z)).
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = prior * (sigmoid(zp) - 1) - prior * sigmoid(zp), sigmoid(zu)
        else:
            gp, gu = prior * (sigmoid(zp) - 1), np.zeros(len(zu))
        gp, gu = gp / len(p), gu / len(u)
        grad = np.bincount(vp, np.repeat(gp, np.diff(bp)), BUCKETS + 1) + np.bincount(vu, np.repeat(gu, np.diff(bu)), BUCKETS + 1)
        grad[-1] = gp.sum() + gu.sum()
        touched = np.flatnonzero((grad != 0) & use)
        size[touched] += grad[touched] ** 2
        w[touched] -= RATE * grad[touched] / np.sqrt(size[touched])
    return w


def zero_point(margin: np.ndarray, prior: float) -> float:
    """Half way between the margins around the top ``prior`` share; equal margins stay below it."""
    high = np.sort(margin)[::-1]
    k = min(max(1, round(prior * len(high))), len(high) - 1)
    above = high[high > high[k]]
    return float((above[-1] + high[k]) / 2) if len(above) else float(high[k]) + 1e-9


def held_out() -> Column:
    """Rows that no model may learn from: one in five by a checksum of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Feature places, weights and bias of each member; empty without positive and other examples.

    Learns from rows of ``labels`` outside the held-out fifth, at most MOST_POSITIVE toxic ones and
    MOST_UNLABELLED of all; null labels are not used.  The prior is the share of toxic labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    every, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < every:
        return []
    prior = toxic / every
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    positive = known.where("toxic = 1").orderBy(order).limit(MOST_POSITIVE).select("doc_id", F.lit(True).alias("positive"))
    unlabelled = known.orderBy(order).limit(MOST_UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    chosen = F.broadcast(positive.union(unlabelled))  # at most MOST_POSITIVE + MOST_UNLABELLED narrow rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")

    def describe(batch):
        for part in words.pieces(batch, "text"):
            values, begin = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("positive"), lists(values.astype(np.int32), begin, pa.int32())], ["doc_id", "positive", "places"]
            )

    def learn(table: pa.Table) -> pa.Table:
        member = table.column("member")[0].as_py()
        table = table.sort_by([("positive", "descending"), ("doc_id", "ascending")])
        places = table.column("places").combine_chunks()
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))])
        values = places.flatten().to_numpy(zero_copy_only=False)
        own = table.column("positive").to_numpy()
        w = train(values, begin, own, min(max(prior, 1e-3), 0.999), member)
        w[-1] -= zero_point(margins(values, begin, w)[~own] + w[-1], prior)
        use = np.flatnonzero(w[:-1])
        return pa.table({"places": [use.astype(np.int32)], "weights": [w[use]], "bias": [w[-1]]})

    rows = one_by_one(texts, describe, "doc_id long, positive boolean, places array<int>")
    rows = rows.withColumn("member", F.explode(F.array([F.lit(k) for k in range(MEMBERS)])))
    models = rows.groupBy("member").applyInArrow(learn, "places array<int>, weights array<double>, bias double")
    return [(np.array(r["places"], np.int64), np.array(r["weights"]), r["bias"]) for r in models.collect()]  # MEMBERS rows


def scorer(models):
    """Function from a text column to scores; dense weights are laid out once a task."""
    dense = []

    def score(column: pa.Array) -> np.ndarray:
        if not dense:
            for places, weights, bias in models:
                w = np.zeros(BUCKETS + 1)
                w[places], w[-1] = weights, bias
                dense.append(w)
        if not dense:
            return np.zeros(len(column))
        values, begin = features(column)
        return np.mean([sigmoid(margins(values, begin, w) + w[-1]) for w in dense], axis=0)

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null texts count as empty and get the score of a text without features; repeated rows get a row
    each; without usable labels every score is 0; other columns are neither read nor kept.
    """
    models = fit(docs, labels)

    def run(batches):
        score = scorer(models)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                s = score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCORES)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose score is below 0.5, all columns kept; nothing is shuffled."""
    models = fit(docs, labels)

    def run(batches):
        score = scorer(models)
        for batch in batches:
            for part in words.pieces(batch, "text"):
                yield part.filter(pa.array(score(part.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
