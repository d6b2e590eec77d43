"""Links among the members of candidate lists, without making all pairs of a list.

Every two members of a list are to be compared unless links already join them.  A round picks a
leader in each list and compares it with the members of other components; after that the leader owes no
comparison and leaves the list, and a list whose members are all in one component is closed.  The
first leader is the member that shares most lists (the original of a group of near copies), later ones come
from the smallest component of the list, so that few outsiders are compared with the many.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import words
from wavemill.llm.shared import components, kept, lists, one_by_one

#: Members that are compared with one copy of their leader's text.
PER_LEADER = 256
#: Members and shingles of a block.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 19
#: Bits of a set's mark, and members of a block and cells of a table that are compared by their marks.
LEAST_MARK, MOST_MARK = 256, 4096
MARKED, CELLS = 4096, 1 << 18
#: Lists of a set that tell where a pair is compared.
LOWEST = 16


def star_rounds(listed: DataFrame, compare: Callable[[DataFrame], DataFrame], rounds: int) -> tuple[DataFrame, DataFrame]:
    """(reached, left) of lists (key, set, size, weight).

    ``compare`` takes distinct pairs (a, size_a, b, size_b) and returns links (a, b).  ``reached`` has (node, component)
    of linked sets, ``left`` the members (key, set, size, weight, component) of lists that are still open after the last round.
    """
    listed = listed.withColumn("component", F.col("set"))
    reached = listed.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(rounds):
        held = listed.groupBy("key", "component").agg(F.count("*").alias("of"), F.max(F.struct("weight", "set", "size")).alias("lead"))
        leads = held.groupBy("key").agg(F.min_by(F.struct("component", "lead"), F.struct("of", -F.col("lead.weight"), "lead.set")).alias("best"))
        leads = leads.select(
            "key", F.col("best.lead.set").alias("a"), F.col("best.lead.size").alias("size_a"), F.col("best.component").alias("component_a")
        )
        stars = listed.join(leads, "key")
        pairs = stars.where("component <> component_a").select("a", "size_a", F.col("set").alias("b"), F.col("size").alias("size_b")).distinct()
        reached = joined(reached, compare(pairs))
        rest = stars.where("set <> a").select("key", "set", "size", "weight")
        rest = rest.join(reached.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        open_ = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        listed = kept(rest.join(open_.select("key"), "key").select("key", "set", "size", "weight", "component"), f"open-{turn}")
        if listed.isEmpty():
            break
    return reached, listed


def joined(reached: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b)."""
    known = reached.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.union(links))


def overlaps(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, common, either): exact intersection and union sizes of shingle sets, for distinct pairs (a, b).

    ``texts`` has one text for each set.  A leader's text travels once for up to PER_LEADER members, which are
    dealt by their hash, so a leader with many members is spread over tasks.
    """
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_LEADER).alias("parts"))
    text = texts.select(F.col("set").alias("b"), "text")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    members = pairs.select("a", "b").join(counted, "a").select("a", part, "b").join(text, "b").select("a", "part", "b", "text")
    leads = counted.join(texts.select(F.col("set").alias("a"), "text"), "a")
    leads = leads.select("a", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    shuffles = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.union(leads).repartition(shuffles, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        led, own = None, None
        for batch in batches:
            for rows in words.pieces(batch, "text"):
                values, _, begin = words.distinct(*words.shingles(*words.words(rows.column("text")), n))
                out = []
                for k, (a, b) in enumerate(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist())):
                    mine = values[begin[k] : begin[k + 1]]
                    if b is None:
                        led, own = a, mine.copy()
                    else:
                        if led != a:
                            raise ValueError("a pair came without its leader")
                        common = len(np.intersect1d(own, mine, assume_unique=True))
                        out.append((a, b, common, len(own) + len(mine) - common))
                if out:
                    cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(cols, ["a", "b", "common", "either"])

    return dealt.mapInArrow(run, "a long, b long, common long, either long")


def alone(sets: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(set, alone): how many shingles of a set none of the other sets has, where there are any."""

    def build(batch):
        for part in words.pieces(batch, "text"):
            values, _, begin = words.distinct(*words.shingles(*words.words(part.column("text")), n))
            owner = np.repeat(part.column("set").to_numpy(), np.diff(begin))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(values.view(np.int64))], ["set", "shingle"])

    held = one_by_one(texts.join(sets, "set").select("set", "text"), build, "set long, shingle long")
    once = held.groupBy("shingle").agg(F.count("*").alias("of"), F.min("set").alias("set")).where("of = 1")
    return once.groupBy("set").agg(F.count("*").alias("alone"))


def marked(batch: pa.RecordBatch, n: int):
    """(set, mark) of a batch (set, text); see ``marks``."""
    for part in words.pieces(batch, "text"):
        values, _, begin = words.distinct(*words.shingles(*words.words(part.column("text")), n))
        sizes = np.diff(begin)
        width = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 2) / 2)).astype(np.int64), LEAST_MARK, MOST_MARK)
        first = np.concatenate([[0], np.cumsum(width)])
        at = words.mix(values, 17) & np.repeat((width - 1).astype(np.uint64), sizes)
        flips = np.bincount(at.astype(np.int64) + np.repeat(first[:-1], sizes), minlength=first[-1]) & 1
        bits = np.packbits(flips.astype(bool), bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("set"), lists(bits, first // 64, pa.int64())], ["set", "mark"])


def marks(sets: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(set, mark): a row of bits for each set, in which every shingle flips one.

    Two marks differ in at most as many bits as the sets differ in shingles.  A mark has one bit for up to two shingles,
    from LEAST_MARK to MOST_MARK; halves of a longer one, put together, are the shorter one.
    """
    return one_by_one(texts.join(sets, "set").select("set", "text"), partial(marked, n=n), "set long, mark array<long>")


def may_link(size: np.ndarray, marked: pa.Array, x: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """(rows x, all rows): whether the marks of two rows differ in no more bits than linked sets do in shingles."""
    top, bottom = threshold
    first = np.asarray(marked.offsets)
    width, bits = np.diff(first), marked.values.to_numpy().view(np.uint64)
    differ = np.zeros((len(x), len(size)), np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width >= w)
        flat = np.zeros((len(size), w), np.uint64)
        for k in np.unique(width[rows]).tolist():
            own = np.flatnonzero(width == k)
            flat[own] = np.bitwise_xor.reduce(bits[first[own][:, None] + np.arange(k)].reshape(len(own), k // w, w), axis=1)
        here = np.minimum(width[x][:, None], width) == w
        apart = np.zeros(differ.shape, np.int64)
        for c in range(w):
            apart += np.bitwise_count(flat[x, c][:, None] ^ flat[:, c])
        differ = np.where(here, apart, differ)
    differ = np.maximum(differ, np.abs(size[x][:, None] - size))
    return differ * (bottom + top) <= (size[x][:, None] + size) * (bottom - top)


def partnered(left: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(key, set) of the members of lists (key, set, size, component, far, mark) that may be linked with one of another component."""
    top, bottom = threshold
    gap = (bottom - top) / bottom + 1e-9
    parts = left.groupBy("key").agg(F.ceil(F.count("*") / MARKED).cast("int").alias("parts"))
    spread = left.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place = ["key", "i", "j"]
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "set", "size", "component", "far", "mark")

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size, component, far = (table.column(c).to_numpy() for c in ("size", "component", "far"))
        marked, found = table.column("mark").chunk(0), np.zeros(len(size), bool)
        step = max(1, CELLS // len(size))
        if component.min() < component.max():
            for a in range(0, len(size), step):
                x = np.arange(a, min(len(size), a + step))
                met = may_link(size, marked, x, threshold) & (component[x][:, None] != component)
                found[x] = (met & ~(np.abs(far[x][:, None] - far) > gap)).any(axis=1)
        return table.select(["key", "set"]).filter(pa.array(found))

    return spread.groupBy(*place).applyInArrow(find, "key long, set long").distinct()


def in_blocks(left: DataFrame, texts: DataFrame, n: int, threshold: tuple[int, int], narrow: Callable) -> DataFrame:
    """Links (a, b) between members of lists, without a row for each pair.  ``left`` has (key, set, size, ...).

    A list's members are dealt by their hash to blocks of bounded number and size, and each two blocks meet in one
    group.  ``narrow(batch, k, others)`` says which of the rows ``others`` row k is to be compared with.  A first pass finds the members
    that have such a partner there; only their texts come to the second one, which compares whole sets.
    A pair that shares several lists is compared in the lowest one, as far as the ``LOWEST`` lists of both tell.
    """
    top, bottom = threshold
    extra = [c for c in left.columns if c not in ("key", "set")]
    parts = left.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    member_of = left.groupBy("set").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOWEST).alias("lists"))
    dealt = left.join(parts, "key").join(member_of, "set").withColumn("own", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    dealt = kept(dealt.select("key", low, high, "own", "set", "lists", *extra), "blocks")
    place = ["key", "i", "j"]

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs to compare in this list."""
        name, block, key = batch.column("set").to_numpy(), batch.column("own").to_numpy(), batch.column("key")[0].as_py()
        same = bool((block == block[0]).all())
        lists = batch.column("lists")
        first, count = np.asarray(lists.offsets)[:-1], np.diff(np.asarray(lists.offsets))
        at = np.minimum(np.arange(LOWEST), count[:, None] - 1)  # short ones are filled up with their last
        low = lists.values.to_numpy()[first[:, None] + at]
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(name)):
            found = narrow(batch, k, np.flatnonzero(name > name[k] if same else block > block[k]))
            if len(found):
                met = (low[found][:, :, None] == low[k]).any(axis=2)
                found = found[np.where(met, low[found], np.iinfo(np.int64).max).min(axis=1) >= key]
            x.append(np.full(len(found), k))
            y.append(found)
        return np.concatenate(x), np.concatenate(y)

    def whole(table: pa.Table) -> pa.RecordBatch:
        return table.combine_chunks().to_batches()[0]

    def find(table: pa.Table) -> pa.Table:
        batch = whole(table)
        some = pa.array(np.unique(np.concatenate(pairs(batch))), pa.int64())
        return pa.Table.from_arrays([batch.column(c).take(some) for c in (*place, "set")], names=[*place, "set"])

    def verify(table: pa.Table) -> pa.Table:
        batch = whole(table)
        held = []
        for part in words.pieces(batch, "text"):
            values, _, begin = words.distinct(*words.shingles(*words.words(part.column("text")), n))
            held += [values[a:b] for a, b in zip(begin[:-1], begin[1:])]
        name = batch.column("set").to_numpy()
        out = []
        for k, m in zip(*(p.tolist() for p in pairs(batch))):
            common = len(np.intersect1d(held[k], held[m], assume_unique=True))
            if common * bottom >= (len(held[k]) + len(held[m]) - common) * top:
                out.append((int(name[k]), int(name[m])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    some = dealt.groupBy(*place).applyInArrow(find, "key long, i int, j int, set long")
    both = dealt.join(some, [*place, "set"]).join(texts, "set").select(*place, "own", "set", "lists", *extra, "text")
    return both.groupBy(*place).applyInArrow(verify, "a long, b long")


def members_of(rows: DataFrame, n: int, sketch: Callable, schema: str) -> DataFrame:
    """(doc_id, tag, ...) of every row by ``sketch(part, values, begin)``; ``tag`` is a hash of the text."""
    tagged = rows.select("doc_id", F.xxhash64("text").alias("tag"), "text")

    def build(batch):
        for part in words.pieces(batch, "text"):
            values, _, begin = words.distinct(*words.shingles(*words.words(part.column("text")), n))
            cols, names = sketch(values, begin)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), *cols], ["doc_id", "tag", *names])

    return one_by_one(tagged, build, f"doc_id long, tag long, {schema}")


def texts_of(rows: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, text): one text for each wanted set.

    A set's text is that of one (doc_id, text hash), so neither rows without id nor copies of a text meet under
    one key; only repeated rows do, and one of them is taken.
    """
    ids = members.join(wanted, "set").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("id"))
    ids = ids.select("set", F.col("id.none").alias("none"), F.coalesce("id.doc_id", F.lit(0)).alias("id"), F.col("id.tag").alias("tag"))
    tagged = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tag"), "text")
    return tagged.join(ids, ["none", "id", "tag"]).select("set", "text").dropDuplicates(["set"])


def named_by_smallest(members: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of members (doc_id, n, set); a set without links is a component by itself."""
    some = members.where("n > 0").join(reached.withColumnRenamed("node", "set"), "set", "left")
    some = some.select("doc_id", "n", F.coalesce("component", "set").alias("component"))
    smallest = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = some.join(smallest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(empty)
