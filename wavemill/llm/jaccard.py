"""Exact n-gram Jaccard join by a size-aware heavy-light method.

Sets are the distinct word shingles of whole texts.  Equal sets are one class and are joined
once.  All sets are put in one global order that has shingles of many documents last, and a set
of size a that is linked with another shares, with the needed overlap t = ceil(threshold * a),
at least k of its first a - t + k shingles.

* light: sets up to the boundary list all 2-subsets of their first a - t + 2 shingles, so that
  two of them meet on a pair of shared shingles;
* heavy: a pair with a larger set meets in inverted lists, to which larger sets, and those close
  enough in size to be linked with one, post their first a - t + k; it must meet k times, where k is
  ``MEETINGS`` or less if a set is too small for that.

The boundary is the size at which the measured number of meetings in inverted lists begins to
cost less than listing subsets.

Candidates are verified by exact set overlap in two rounds.  First each list's leading set, the one
that shares the most lists, is compared with all others of the list, which joins a group of near copies with a few times as
many comparisons as it has members.  Then only pairs of a list that are still in different
components are compared, leaving out those that the triangle inequality of the Jaccard distance
rules out, and those in which shingles that nobody else posted leave too little to share.  A pair that is left out so is either in one component already or not linked.
Pairs of short lists become rows; those of lists with over ``LISTED`` sets are found and verified inside bounded blocks (``stars.in_blocks``), after
``stars.partnered`` has taken out by short marks those without any possible partner, so that a crowd of near copies makes no row for each of its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm import words
from wavemill.llm.shared import components, kept, one_by_one
from wavemill.llm.stars import in_blocks, marks, partnered, texts_of

#: Largest set size for which subsets are considered.
LIGHT_LIMIT = 64
#: A shingle held by this share of all documents, or of those of one task, may be common.
COMMON_SHARE = 1 / 2000
#: Inverted lists in which a pair must meet.
MEETINGS = 8
#: Documents of one task that must hold a shingle before the task reports it.
COMMON_LEAST = 8
#: Sets of a list whose pairs may become rows.
LISTED = 48
#: Words of 64 bits that tell which lists a set is in.
BITS = 8

SKETCH = "kind int, doc_id long, n long, h long, g long"


def _sets(batch: pa.RecordBatch, n: int):
    """(rows, values, begin) of the distinct shingles of each part of a batch, values sorted."""
    for part in words.pieces(batch, "text"):
        runs, begin = words.shingles(*words.words(part.column("text")), n)
        values, _, begin = words.distinct(runs, begin)
        yield part, values, begin


def _identity(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words.mix(values, 11), out=total[1:])
        return words.mix(total[begin[1:]] - total[begin[:-1]]).view(np.int64)


def prefix_sizes(sizes: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """How many first shingles two linked sets must share one of: size - needed overlap + 1."""
    top, bottom = threshold
    return sizes - (-(-sizes * top // bottom)) + 1


def meetings(light: int, threshold: tuple[int, int]) -> int:
    """Shared shingles that every linked pair with a set above ``light`` is sure to have, up to MEETINGS."""
    top, bottom = threshold
    smallest = -(-(light + 1) * top // bottom)
    return max(1, min(MEETINGS, -(-smallest * top // bottom)))


def sketch(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """One narrow pass over all texts; rows of three kinds.

    0: doc_id, set size, and the hashes of the set (h) and the text (g); 1: a shingle (h) that n documents of
    one task hold, if they are many; 2: a first shingle (h) of a small set of size n.
    """

    def run(batches):
        held, docs_seen = {}, 0

        def row(kind, doc_id, n, h, g):
            size = len(h)
            cols = [np.full(size, kind, np.int32), doc_id, n, h, g]
            cols = [pa.array(c if c is not None else np.zeros(size, np.int64)) for c in cols]
            return pa.RecordBatch.from_arrays(cols, ["kind", "doc_id", "n", "h", "g"])

        for batch in batches:
            for part, values, begin in _sets(batch, n):
                sizes = np.diff(begin)
                h = _identity(values, begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(h), np.int32)), part.column("doc_id"), pa.array(sizes), pa.array(h), part.column("tag")],
                    ["kind", "doc_id", "n", "h", "g"],
                )
                docs_seen += part.num_rows
                seen, counts = np.unique(values, return_counts=True)
                often = counts >= 2
                for v, c in zip(seen[often].tolist(), counts[often].tolist()):
                    held[v] = held.get(v, 0) + c
                if len(held) > 1_000_000:
                    held = {v: c for v, c in held.items() if c >= max(3, docs_seen * COMMON_SHARE / 2)}
                small = np.flatnonzero((sizes > 1) & (sizes <= LIGHT_LIMIT))
                if len(small):
                    take = prefix_sizes(sizes[small], threshold)
                    at = np.repeat(begin[small] - np.cumsum(take) + take, take) + np.arange(take.sum())
                    yield row(2, None, np.repeat(sizes[small], take), values[at].view(np.int64), None)
        least = max(COMMON_LEAST, docs_seen * COMMON_SHARE)
        common = {v: c for v, c in held.items() if c >= least}
        if common:
            v = np.array(list(common), np.uint64).view(np.int64)
            yield row(1, None, np.array(list(common.values()), np.int64), v, None)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, SKETCH)


def boundary(sketched: DataFrame, threshold: tuple[int, int]) -> int:
    """Set size up to which listing subsets costs no more than scanning lists; 0 if none does."""
    rows = sketched.where("kind = 2").select("h", "n")
    met = rows.groupBy("h").agg(F.count("*").alias("f"))
    scan = rows.groupBy("h", "n").agg(F.count("*").alias("c")).join(met, "h").groupBy("n").agg(F.sum(F.col("c") * F.col("f")).alias("cost"))
    docs = sketched.where(f"kind = 0 AND n > 1 AND n <= {LIGHT_LIMIT}").groupBy("n").agg(F.countDistinct("h").alias("docs"))
    table = {r["n"]: (r["docs"], r["cost"] or 0) for r in docs.join(scan, "n", "left").collect()}  # at most LIGHT_LIMIT rows
    best, gain, chosen = 0, 0, 0
    for a in range(2, LIGHT_LIMIT + 1):
        count, cost = table.get(a, (0, 0))
        p = int(prefix_sizes(np.array([a]), threshold)[0])
        gain += cost - count * p * (p + 1) // 2
        if gain > best:
            best, chosen = gain, a
    return chosen


def _order(values: np.ndarray, begin: np.ndarray, common: np.ndarray, level: np.ndarray) -> None:
    """Sort each set in place by (how common, hash): rare shingles first."""
    if not len(common):
        return
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    grade = np.where(common[at] == values, level[at], 0)
    for t in np.unique(np.searchsorted(begin, np.flatnonzero(grade), "right") - 1).tolist():
        a, b = begin[t], begin[t + 1]
        values[a:b] = values[a:b][np.lexsort((values[a:b], grade[a:b]))]


def postings(docs: DataFrame, n: int, threshold: tuple[int, int], light: int, common: dict[int, int]) -> DataFrame:
    """(key, set, info, hot, pair) for every list of a set; hot: of common shingles only; pair: of a subset.

    ``info`` packs the set size, how many rare (not common) shingles it posted, and whether those are
    all the rare ones that it has.
    """
    names = np.array(sorted(common), np.uint64)
    level = np.array([common[int(v)].bit_length() for v in names], np.int64)
    top, bottom = threshold

    def build(batch):
        for part, values, begin in _sets(batch, n):
            h = _identity(values, begin)
            _order(values, begin, names, level)
            sizes = np.diff(begin)
            hot_value = np.isin(values, names) if len(names) else np.zeros(len(values), bool)
            # Light sets post too: lists with larger sets need some, and all tell what nobody else has.
            many = np.flatnonzero(sizes > 1)
            take = np.minimum(sizes[many], prefix_sizes(sizes[many], threshold) + meetings(light, threshold) - 1)
            at = np.repeat(begin[many] - np.cumsum(take) + take, take) + np.arange(take.sum())
            owner, key, hot = np.repeat(many, take), words.mix(values[at], 1), hot_value[at]
            posted_rare = np.bincount(owner[~hot], minlength=len(sizes))
            posted_all = np.bincount(owner, minlength=len(sizes))
            all_rare = (posted_rare < posted_all) | (posted_all == sizes)  # rare ones come first
            info = sizes << 33 | posted_rare << 1 | all_rare
            few = np.flatnonzero((sizes > 1) & (sizes <= light))
            owners, keys, hots = [owner], [key], [hot]
            with np.errstate(over="ignore"):
                for a in np.unique(sizes[few]).tolist():
                    own = few[sizes[few] == a]
                    p = int(prefix_sizes(np.array([a]), threshold)[0]) + 1
                    i, j = np.triu_indices(p, 1)
                    grid = begin[own][:, None]
                    low, high = values[grid + i], values[grid + j]
                    owners.append(np.repeat(own, len(i)))
                    keys.append((words.mix(low, 2) * np.uint64(3) + words.mix(high, 3)).ravel())
                    hots.append((hot_value[grid + i] & hot_value[grid + j]).ravel())
            owner = np.concatenate(owners)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(h[owner]),
                    pa.array(info[owner]),
                    pa.array(np.concatenate(hots)),
                    pa.array(np.arange(len(owner)) >= len(at)),
                ],
                ["key", "set", "info", "hot", "pair"],
            )

    return one_by_one(docs.select("text"), build, "key long, set long, info long, hot boolean, pair boolean")


def overlaps(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, common, either): exact intersection and union sizes of pairs of sets.

    ``texts`` has one text for each set.  Both joins are on near-unique set hashes on one side, so
    adaptive execution can split the sets that take part in many pairs.
    """
    left = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def build(batch):
        size = max(1, batch.num_rows * (2 << 20) // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            x, xb, _ = _values(part.column("ta"), n)
            y, yb, _ = _values(part.column("tb"), n)
            common = np.array(
                [len(np.intersect1d(x[a:b], y[c:d], assume_unique=True)) for a, b, c, d in zip(xb[:-1], xb[1:], yb[:-1], yb[1:])], np.int64
            )
            either = np.diff(xb) + np.diff(yb) - common
            yield pa.RecordBatch.from_arrays(
                [part.column("a"), part.column("b"), pa.array(common), pa.array(either)], ["a", "b", "common", "either"]
            )

    return one_by_one(both, build, "a long, b long, common long, either long")


def _values(column: pa.Array, n: int):
    runs, begin = words.shingles(*words.words(column), n)
    values, counts, begin = words.distinct(runs, begin)
    return values, begin, counts


def near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row, from ``groups``."""
    members = groups(docs, n, threshold)
    some = members.where("component IS NOT NULL")
    smallest = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = some.join(smallest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("component IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(empty)


def rejects(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, tag, rows, goes) of the texts that go, all but one of a component, and of those that occur in several rows.

    The smallest (doc_id, hash of the text) stays, a row without doc_id only if all of its component are.
    """
    some = groups(docs, n, threshold).where("component IS NOT NULL").groupBy("component", "doc_id", "tag").agg(F.count("*").alias("rows"))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    best = some.groupBy("component").agg(F.min(name).alias("best"))
    told = some.join(best, "component").withColumn("goes", ~name.eqNullSafe(F.col("best")))
    return told.where("goes OR rows > 1").select("doc_id", "tag", "rows", "goes")


def groups(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, tag, n, component) of every row: a hash of its text, its set size, and its component or null without words.

    Two rows are linked if intersection / union of their shingle sets reaches ``threshold``, and a
    component is what links reach; its id is its smallest doc_id.  The threshold is above one half.  A text with fewer than ``n``
    words has its whole sequence as one shingle; null texts and texts without words have none and
    stay alone.  Repeated rows stay, all in one component.  A row without doc_id can carry links
    but names no component unless all of the component is without.  Other columns are left out.
    """
    top, bottom = threshold
    if 2 * top <= bottom:
        raise ValueError("thresholds of one half or less need other filters")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = kept(sketch(rows, n, threshold), "sketch")
    members = sketched.where("kind = 0").select("doc_id", F.col("g").alias("tag"), "n", F.col("h").alias("set"))
    total = members.count()
    least = max(COMMON_LEAST, total * COMMON_SHARE)
    often = sketched.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # At most mean set size / COMMON_SHARE shingles can reach the share, whatever the number of documents.
    common = {r["h"] % (1 << 64): int(r["n"]) for r in often.collect()}
    light = boundary(sketched, threshold)

    posted = postings(rows, n, threshold, light, common)
    columns = ["key", "pair", "hot", "set", "info", "members"]
    rare = posted.where("NOT hot").withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1")
    hot = posted.where("hot").select("key", "set", "info", "hot", "pair").distinct()
    hot = hot.join(hot.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key")
    listed = kept(rare.select(*columns).union(hot.select(*columns)), "lists")

    # A set that is in too few lists with others to meet any of them often enough is out.
    active = listed.groupBy("set").agg(F.max("pair").alias("subset"), F.count_distinct("key").alias("lists"), F.sum("members").alias("weight"))
    active = active.where(F.col("subset") | (F.col("lists") >= meetings(light, threshold))).select("set", "weight")
    listed = listed.join(active, "set").drop("members").withColumn("size", F.shiftright("info", 33))
    # The original of a group of near copies shares more of its lists than any copy, so it leads them.
    leads = listed.groupBy("key").agg(F.max(F.struct("weight", "set", "size")).alias("lead"), F.count_distinct("set").alias("n")).where("n > 1")
    leads = leads.select("key", F.col("lead.set").alias("pivot"), F.col("lead.size").alias("pivot_size"))
    listed = kept(listed.join(leads, "key").drop("weight").distinct(), "led")
    # Rare shingles that a set posted and no other left set did: a set that posted all of its own lacks them.
    shared = listed.groupBy("set", "info").agg(F.count_distinct(F.when(~F.col("hot") & ~F.col("pair"), F.col("key"))).alias("shared"))
    alone = shared.select("set", (F.shiftright(F.col("info").bitwiseAND((1 << 33) - 1), 1) - F.col("shared")).alias("alone"), (F.col("info") % 2 == 1).alias("all"))
    listed = listed.drop("info", "hot").join(alone, "set")

    # One text for each set that is left.
    wanted = listed.select("set").distinct()
    texts = kept(texts_of(rows, members, wanted), "texts")

    def close(small, large):
        return small * bottom >= large * top

    def enough(left: str, right: str):
        """The overlap that two sets can have at most is enough."""
        a = F.col(f"size{left}") - F.when(F.col(f"all{right}"), F.col(f"alone{left}")).otherwise(0)
        b = F.col(f"size{right}") - F.when(F.col(f"all{left}"), F.col(f"alone{right}")).otherwise(0)
        most = F.least(a, b)
        return most * bottom >= (F.col(f"size{left}") + F.col(f"size{right}") - most) * top

    def candidates(met: DataFrame) -> DataFrame:
        """Pairs (a, b) that met on a subset or often enough on single shingles."""
        met = met.groupBy("a", "b").agg(F.max("pair").alias("subset"), F.count_distinct("key").alias("lists"))
        return met.where(F.col("subset") | (F.col("lists") >= meetings(light, threshold))).select("a", "b")

    stars = listed.where(F.col("set") != F.col("pivot")).where(close(F.least("size", "pivot_size"), F.greatest("size", "pivot_size")))
    stars = stars.select(F.col("pivot").alias("a"), F.col("set").alias("b"), "key", "pair")
    first = kept(overlaps(candidates(stars), texts, n), "stars")
    linked = (F.col("common") * bottom >= F.col("either") * top) & (F.col("either") > 0)
    found = components(first.where(linked).select("a", "b"))

    placed = listed.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    counted = placed.groupBy("key", "component").agg(F.count_distinct("set").alias("n"))
    open_ = counted.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    near = first.select(F.col("a").alias("pivot"), F.col("b").alias("set"), (1 - F.col("common") / F.col("either")).alias("far"))
    apart = placed.join(open_.select("key", F.col("most.component").alias("major")), "key").join(near, ["pivot", "set"], "left")
    apart = apart.withColumn("far", F.when(F.col("set") == F.col("pivot"), 0.0).otherwise(F.col("far"))).distinct()
    many = apart.groupBy("key").agg((F.count("*") > LISTED).alias("many"))
    apart = kept(apart.join(many, "key"), "apart")
    named = ["set", "size", "alone", "all", "component", "far"]
    short = apart.where("NOT many")
    left = short.select("key", "pair", "major", *(F.col(c).alias(f"{c}_a") for c in named)).where("component_a <> major")
    right = short.select("key", *(F.col(c).alias(f"{c}_b") for c in named))
    gap = (bottom - top) / bottom + 1e-9
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    # The largest component of a list meets the others, never itself; the others meet once.
    rest = left.join(right, "key").where(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("major")) | (F.col("set_a") < F.col("set_b")))
        & close(small, large)
        & enough("_a", "_b")
        & F.coalesce(F.abs(F.col("far_a") - F.col("far_b")) <= gap, F.lit(True))
    )
    rest = rest.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"), "key", "pair")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = candidates(rest).join(done, ["a", "b"], "left_anti")
    second = kept(overlaps(rest, texts, n), "rest")
    links = first.where(linked).select("a", "b").union(second.where(linked).select("a", "b"))
    crowds = apart.where("many").select("key", "pair", *named)
    # Documents that have but a passage in common go here, by a short mark of each set.
    marked = marks(crowds.select("set").distinct(), texts, n)
    some = partnered(crowds.select("key", "set", "size", "component", "far").join(marked, "set"), threshold)
    crowds = crowds.join(kept(some, "partnered"), ["key", "set"]).join(list_bits(apart), "set")
    third = in_blocks(crowds, texts, n, threshold, narrowing(meetings(light, threshold), threshold))
    reached = components(links.union(kept(third, "crowds")))

    named = members.join(reached.withColumnRenamed("node", "set"), "set", "left")
    return named.select("doc_id", "tag", "n", F.when(F.col("n") > 0, F.coalesce("component", "set")).alias("component"))


def list_bits(listed: DataFrame) -> DataFrame:
    """(set, bits): a set's lists as bits of 64 * BITS, a list the same one in every set."""
    bit = F.expr("shiftleft(1L, CAST(pmod(key, 64) AS INT))")
    slot = F.pmod(F.shiftright("key", 6), F.lit(BITS))
    words_ = [F.bit_or(F.when(slot == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(BITS)]
    return listed.groupBy("set").agg(*words_).select("set", F.array(*(f"b{k}" for k in range(BITS))).alias("bits"))


def narrowing(least: int, threshold: tuple[int, int]):
    """Pairs of a block that may be linked, by the same rules as those of short lists."""
    top, bottom = threshold
    gap = (bottom - top) / bottom + 1e-9

    def narrow(batch: pa.RecordBatch, k: int, others: np.ndarray) -> np.ndarray:
        size, alone, component = (batch.column(c).to_numpy() for c in ("size", "alone", "component"))
        whole = batch.column("all").to_numpy(zero_copy_only=False)
        far = batch.column("far").to_numpy(zero_copy_only=False)  # NaN: not compared with the leader
        y = others[component[others] != component[k]]
        most = np.minimum(size[k] - np.where(whole[y], alone[k], 0), size[y] - (alone[y] if whole[k] else 0))
        y = y[(most * bottom >= (size[k] + size[y] - most) * top) & ~(np.abs(far[y] - far[k]) > gap)]
        if batch.column("pair")[0].as_py():
            return y
        # Eight shared lists set fewer than two common bits with a chance of 1e-18.
        bits = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, BITS)
        return y[np.bitwise_count(bits[y] & bits[k]).sum(axis=1) >= max(1, least // 4)]

    return narrow
