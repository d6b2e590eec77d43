"""Line dedup, decontamination, toxicity, near duplicates, search."""

import math
import pickle
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import best_window, jaccard_components, template_drops, words_of
from wavemill.llm import decontaminate, jaccard, lines, search, shared, stars, toxicity, words
from wavemill.llm.queries import benchmark_leaks, bm25_search

ODD = [(1, None), (2, ""), (3, " \n \n"), (4, "word"), (5, "word"), (6, "a b c d"), (7, "a b c d e"), (8, "A b c d e"), (None, "a b c d e f")]


def near_copies(rng, groups=12):
    rows, vocabulary = [], [f"w{k}" for k in range(400)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 8, 12, 30, 60, 90, 200]))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += [rng.choice(vocabulary) for _ in range(rng.randint(1, 6))]
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rng.shuffle(rows)
    return rows


def groups_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_like_all_pairs(docs_of, seed):
    rows = near_copies(random.Random(seed))
    assert groups_of(jaccard.near_duplicates(docs_of(rows))) == jaccard_components(rows)


def test_near_duplicates_with_a_common_passage_and_a_chain(docs_of):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, passage + " " + " ".join(f"x{k}_{j}" for j in range(rng.randint(0, 14)))) for k in range(60)]
    base = [f"c{k}" for k in range(100)]
    for k in range(12):  # each is near the next one only
        rows.append((100 + k, " ".join(base[k * 6 :] + [f"d{j}" for j in range(k * 6)])))
    assert groups_of(jaccard.near_duplicates(docs_of(rows))) == jaccard_components(rows)


def test_crowds_send_one_row_for_each_set(docs_of, monkeypatch):
    """Sets of a long list are told apart by a mark each; their shingles don't travel."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"x{k}_{j}" for j in range(rng.choice([5, 12, 30, 90])))) for k in range(150)]
    rows += [(200 + k, " ".join(f"y{j}" for j in range(3000)) + f" z{k}" * (k % 5)) for k in range(70)]
    schemas = []

    def watched(df, fn, schema):
        schemas.append(schema)
        return stars_one_by_one(df, fn, schema)

    stars_one_by_one = stars.one_by_one
    monkeypatch.setattr(stars, "one_by_one", watched)
    monkeypatch.setattr(jaccard, "LISTED", 8)
    assert groups_of(jaccard.near_duplicates(docs_of(rows))) == jaccard_components(rows)
    assert schemas == ["set long, mark array<long>"]


def test_marks_differ_no_more_than_sets():
    rng = np.random.default_rng(6)
    words_ = np.array([f"w{k}" for k in range(40_000)])
    texts = []
    for size in (1, 3, 40, 300, 520, 700, 1500, 9000):
        base = rng.choice(words_, size)
        for change in (0, 0, 0.02, 0.3):
            own = base.copy()
            at = rng.random(size) < change
            own[at] = rng.choice(words_, at.sum())
            texts.append(" ".join(own))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["set", "text"])
    got = pa.Table.from_batches(stars.marked(batch, 5)).combine_chunks()
    sets = [set(v.tolist()) for v in (jaccard._values(pa.array([t]), 5)[0] for t in texts)]
    sizes = np.array([len(s) for s in sets])
    close = stars.may_link(sizes, got.column("mark").chunk(0), np.arange(len(texts)), (80, 100))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            linked = 100 * len(a & b) >= 80 * len(a | b)
            assert close[x, y] if linked else not close[x, y] or len(a & b) > 0.4 * len(a | b)


def test_near_duplicates_whatever_the_boundary(docs_of, monkeypatch):
    rows = near_copies(random.Random(9), 8)
    want = jaccard_components(rows)
    for light in (0, 10):
        monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
        assert groups_of(jaccard.near_duplicates(docs_of(rows))) == want


def test_near_duplicates_of_odd_rows(docs_of):
    docs = docs_of(ODD + [(4, "word")]).withColumn("set", F.lit(1)).withColumn("key", F.lit("x"))
    got = groups_of(jaccard.near_duplicates(docs))
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == got[5] == (1, 4) and got[6] == (1, 6) and got[7] == got[8] == (1, 7)
    assert jaccard.near_duplicates(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        jaccard.near_duplicates(docs_of(ODD), threshold=(1, 2))


def test_line_dedup_like_plain_rules(docs_of, sample):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    for k in range(30):
        rows.append((10_000 + k, f"Own line of document number {k} here {rng.random()}\nServed to user {k} on port {k * 7} with code ok\nSubscribe to our daily letter now\nshort one"))
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(docs_of(rows)).collect()}
    want = template_drops(rows)
    assert got == want
    assert sum("Served to user" in t for d, t in got.items() if d >= 10_000) == 1
    assert all("short one" in t for d, t in got.items() if d >= 10_000)


def test_line_dedup_of_odd_rows(docs_of):
    rows = ODD + [(9, "a line of five words\n\nother")] * 2
    docs = docs_of(rows).withColumn("key", F.lit(1)).withColumn("places", F.lit("x"))
    out = lines.deduplicate_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert lines.deduplicate_lines(docs_of([])).count() == 0


def test_leaks_like_all_windows(spark, docs_of):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 3, 5, 9, 15, 20, 33, 49, 60, 100, 140])]
    items += [(50, None), (51, " ")]
    rows = []
    for k in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if k % 2:
            part = words_of(rng.choice(items[:11])[1])
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            cut = rng.randint(0, len(own))
            own[cut:cut] = part
        rows.append((k, " ".join(own).upper() if k % 7 == 0 else " ".join(own)))
    rows += [(100, None), (101, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    want = {(d, i): s for d, t in rows for i, x in items if words_of(x) and words_of(t) and (s := best_window(t, x)) >= 0.8}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    clean = decontaminate.decontaminate(docs_of(rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs_of(rows), none).count() == 0
    assert decontaminate.decontaminate(docs_of(rows), none).count() == len(rows)


def test_leaks_with_moved_and_cut_parts_like_all_windows(spark, docs_of):
    rng = random.Random(8)
    items, rows = [], []
    for k, n in enumerate([*range(40, 50), *range(84, 92), 60, 130]):
        own = [f"i{k}_{j}" for j in range(n)]
        if k % 5 == 4:  # the item says something twice
            own[n // 2 : n // 2 + 6] = own[3:9]
        items.append((k, " ".join(own)))
        a, b = n // 2, n // 3
        edited = [own[a:] + own[:a], own[:b] + ["new"] + own[b : 2 * b] + own[2 * b + 1 :], own[2 * b :] + own[b : 2 * b] + own[:b]]
        edited += [own[:a] + own[a + 2 :], own[:a] + own[a + 8 :], own[: n // 2 + 6] + own[9:], own[3:9] + own[n // 2 + 6 :] + own[:3] + own[9 : n // 2]]
        for e in edited:
            for before in (0, *rng.sample(range(1, 60), 3)):
                rest = [f"d{len(rows)}_{j}" for j in range(before + 7 * (before > 0))]
                rows.append((len(rows), " ".join(rest[:before] + e + rest[before:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs_of(rows), bench).collect()}
    want = {(d, i): s for d, t in rows for i, x in items if f"i{i}_1 " in t and (s := best_window(t, x)) >= 0.8}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_registered_leaks_are_all_of_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_leaks(spark, d).collect()}
    assert got == {(x["doc_id"], i["item_id"]) for x in docs for i in items if best_window(x["text"], i["text"]) >= 0.8}


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    entries = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    queries = entries[:200].copy()
    for k in range(200):
        for b in rng.choice(64, k % 6, replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(b)
    q, e = decontaminate.HammingIndex(entries).within(queries)
    want = {(a, b) for a in range(200) for b in range(300) if int(queries[a] ^ entries[b]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), e.tolist())) == want


def test_simhash_is_the_majority_of_bits():
    word = words.words(pa.array(["a b c a d e f g h i"]))[0]
    got = decontaminate.simhash(word, 4, np.arange(7))
    for s in range(7):
        for bit in range(64):
            byte, place = divmod(bit, 8)
            at = np.uint64(8 * byte + 7 - place)
            ones = sum(int(w >> at) & 1 for w in word[s : s + 4])
            assert (int(got[s] >> at) & 1) == (ones > 2)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert min(r["score"] for r in rows) >= 0 and max(r["score"] for r in rows) <= 1
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit >= 0.9 * sum(r["toxic"] for r in rows)
    assert hit >= 0.9 * sum(r["predicted"] for r in rows)


def test_toxicity_never_learns_from_held_out_labels(spark, sample):
    import zlib

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    flip = [(r["doc_id"], 1 - r["toxic"] if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else r["toxic"]) for r in labels]
    a = toxicity.scores(sample, spark.createDataFrame(labels)).orderBy("doc_id").collect()
    b = toxicity.scores(sample, spark.createDataFrame(flip, "doc_id long, toxic int")).orderBy("doc_id").collect()
    assert a == b


def test_toxicity_of_odd_rows(spark, docs_of, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = sample.select("doc_id", "text", "lang", "source", "n_chars").union(docs_of([(None, None), (-1, ""), (-1, "")]))
    got = [r for r in toxicity.scores(rows, labels).collect() if r["doc_id"] in (None, -1)]
    assert len(got) == 3 and len({r["score"] for r in got}) == 1
    none = labels.where("false")
    assert {(r["score"], r["predicted"]) for r in toxicity.scores(docs_of(ODD), none).collect()} == {(0.0, 0)}
    assert toxicity.scores(docs_of([]), labels).count() == 0
    kept = toxicity.reject(sample, labels)
    assert kept.columns == sample.columns and 0 < kept.count() < sample.count()


def plain_bm25(rows, k=10, terms=search.QUERY_TERMS):
    tf = {d: Counter(words_of(t)) for d, t in rows}
    n, total = len(rows), sum(len(words_of(t)) for _, t in rows)
    df = Counter(w for c in tf.values() for w in c)
    number = {w: int(words.words(pa.array([w]))[0].view(np.int64)[0]) for w in df}
    idf = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) for w in df}
    out = {}
    for q, c in tf.items():
        if q % 20 == 0:
            own = sorted(sorted(c, key=lambda w: (-(1 + math.log(c[w])) * idf[w], number[w]))[:terms], key=number.get)
            scores = []
            for d, t in tf.items():
                length = sum(t.values()) / (total / n)
                s = sum(float(np.float32(t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * length)))) * idf[w] for w in own if w in t)
                if s:
                    scores.append((-round(s, 9), d))
            out[q] = sorted(scores)[:k]
    return out


def test_search_like_scoring_everything(sample, docs_of):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()] + [(-20, None), (-40, "")]
    docs = docs_of(rows).repartition(4)
    got = defaultdict(list)
    for r in search.top_k(docs, docs.where("doc_id % 20 = 0")).orderBy("query", "rank").collect():
        got[r["query"]].append((-r["score"], r["doc_id"]))
    want = {q: s for q, s in plain_bm25(rows).items() if s}
    assert {q: [d for _, d in s] for q, s in got.items()} == {q: [d for _, d in s] for q, s in want.items()}
    assert all(abs(a[0] - b[0]) < 1e-8 for q in want for a, b in zip(got[q], want[q]))
    empty = docs.where("false")
    assert search.top_k(empty, empty).count() == 0


def test_registered_search_asks_with_the_whole_text(spark, sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    tf = {d: Counter(words_of(t)) for d, t in rows}
    n, mean = len(rows), sum(sum(c.values()) for c in tf.values()) / len(rows)
    df = Counter(w for c in tf.values() for w in c)
    got = defaultdict(list)
    for r in bm25_search(spark, "/root/testdata/sf0.001").orderBy("query", "rank").collect():
        got[r["query"]].append((r["doc_id"], r["score"]))
    assert max(len(tf[q]) for q in got) > 16 and set(got) == {d for d in tf if d % 20 == 0 and tf[d]}
    for q, own in got.items():
        scores = {}
        for d, c in tf.items():
            base = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            scores[d] = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + base) for w, m in tf[q].items() if w in c)
        want = sorted((s for s in scores.values() if s), reverse=True)[:10]
        assert len(own) == len(want) and all(abs(s - x) < 1e-5 * x and abs(s - scores[d]) < 1e-5 * x for (d, s), x in zip(own, want))


def test_few_and_many_terms_score_alike(docs_of, sample, monkeypatch):
    docs = docs_of([(r["doc_id"], r["text"]) for r in sample.collect()] + [(-20, "the of and"), (-40, "a")])
    found = []
    for few in (0, 8, 100_000):
        monkeypatch.setattr(search, "FEW_TERMS", few)
        asked = docs.where("doc_id < 0 or doc_id % 100 = 0")
        found.append({(r["query"], r["rank"]): (r["doc_id"], round(r["score"], 7)) for r in search.top_k(docs, asked, by_frequency=True).collect()})
    assert found[0] and found[0] == found[1] == found[2]


def test_shards_take_little_memory_beside_their_postings():
    rng = np.random.default_rng(1)
    words_ = [f"word{k}" for k in range(20_000)]
    column = pa.array([" ".join(words_[k] for k in rng.zipf(1.3, 300) % 20_000) for _ in range(8_000)])
    tracemalloc.start()
    values, counts, begin, length = search.counted(column)
    assert tracemalloc.get_traced_memory()[1] < 8 * column.nbytes
    doc = np.repeat(np.arange(8_000, dtype=np.int32), np.diff(begin))
    order = np.argsort(values, kind="stable")
    term, first = np.unique(values[order], return_index=True)
    first = np.append(first, len(values)).astype(np.int32)
    impact = counts[order].astype(np.float32)
    shard = search.Shard(np.arange(8_000), term, first, doc[order], impact, np.maximum.reduceat(impact, search.block_starts(first)))
    some = slice(0, begin[400])
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found = list(shard.search(doc[some].astype(np.int64), values[some], counts[some].astype(float), 3))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert len(found) == 1_200 and peak < 80 << 20
    whole = search.words.distinct(*search.words.words(column))
    assert (values == whole[0].view(np.int64)).all() and (counts == whole[1]).all() and (begin == whole[2]).all()
    assert length.tolist() == [300] * 8_000


def test_best_of_many_shards_like_scoring_everything():
    """Shards in any order, ties between them, few and many terms, documents that come twice."""
    rng = np.random.default_rng(3)
    tf = np.where(rng.random((400, 60)) < rng.choice([0.05, 0.3], 60), rng.integers(1, 4, (400, 60)), 0)
    tf[100:160] = tf[0]
    ids = np.append(np.arange(398), [7, 7]) * 3
    asked = np.where(rng.random((30, 60)) < rng.choice([0.03, 0.5], 30)[:, None], rng.integers(1, 9, (30, 60)) / 4, 0)
    query, term = np.nonzero(asked)
    best = search.Best(query, term, asked[query, term], 6)
    for part in np.array_split(rng.permutation(400), 23):
        t, d = np.nonzero(tf[part].T)
        terms, first = np.unique(t, return_index=True)
        first = np.append(first, len(t)).astype(np.int32)
        impact = tf[part][d, t].astype(np.float32)
        best.add(search.Shard(ids[part], terms, first, d.astype(np.int32), impact, np.maximum.reduceat(impact, search.block_starts(first))))
        assert len(best.held[0]) <= 6 * 30
    got = defaultdict(list)
    for q, d, s in zip(*best.rows()):
        got[q].append((-s, d))
    scores = asked @ tf.T
    want = {q: sorted((-s, d) for s, d in zip(scores[q], ids) if s)[:6] for q in range(30) if scores[q].any()}
    assert got == want


def test_sent_queries_have_plain_dtypes():
    """``np.add.at`` is quick only for arrays with numpy's own dtype objects, which pickled arrays don't have."""
    sent = pickle.loads(pickle.dumps((np.array([4, 4, 9]), np.array([1, 2, 1]), np.array([0.5, 1.0, 2.0]))))
    best = search.Best(*sent, 3)
    assert best.weight.dtype is np.dtype(np.float64) and best.own.dtype is np.dtype(np.int64) and best.query.dtype is np.dtype(np.int64)


def test_shards_are_small_and_read_one_by_one(docs_of):
    """Neither a task's Python nor Spark's reader holds more than one small shard of a partition."""
    rng = np.random.default_rng(2)
    names = np.array([f"word{k}" for k in range(5_000)])
    docs = docs_of([(k, " ".join(names[rng.zipf(1.3, 500) % 5_000])) for k in range(5_000)]).repartition(1)
    index = search.build_index(docs, 500.0)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    rows = [m.row_group(g).num_rows for m in groups for g in range(m.num_row_groups)]
    assert len(rows) >= 3 and set(rows) == {1}

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    got = shared.kept(index.mapInArrow(seen, "rows long, bytes long"), "seen", batch=search.BATCH_BYTES).collect()
    assert sum(r["rows"] for r in got) == len(rows) and max(r["bytes"] for r in got) < 3 * search.BATCH_BYTES


def test_search_is_the_same_in_any_shards(docs_of, sample, monkeypatch):
    docs = docs_of([(r["doc_id"], r["text"]) for r in sample.collect()] * 2 + [(-20, "the of and"), (-40, "a")])
    asked, found = docs.where("doc_id < 0 or doc_id % 100 = 0"), []
    for size, queries in ((4 << 20, 1 << 15), (10_000, 3)):
        monkeypatch.setattr(search, "SHARD_BYTES", size)
        monkeypatch.setattr(search, "SENT_QUERIES", queries)
        found.append({(r["query"], r["rank"]): (r["doc_id"], round(r["score"], 7)) for r in search.top_k(docs.repartition(2, "doc_id"), asked, by_frequency=True).collect()})
    assert found[0] and found[0] == found[1]


def test_wand_like_full_scores():
    rng = random.Random(7)
    for _ in range(60):
        cursors, scores = [], Counter()
        for _ in range(rng.randint(1, 5)):
            docs = sorted(rng.sample(range(600), rng.randint(1, 400)))
            own = [rng.choice([0.5, 1.0, rng.random() * 5]) for _ in docs]
            for d, s in zip(docs, own):
                scores[d] += s
            cursors.append(search.Cursor(docs, own, [max(own[a : a + search.BLOCK]) for a in range(0, len(docs), search.BLOCK)]))
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
        got = search.wand(cursors, 10)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for _, s in want]


def test_shuffles_of_kept_tables_go_at_once(spark):
    """The files of a written table's shuffles are not left to the garbage collector; the session's setting stays."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()) if f.getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(shared.CLEANUP)
    table = shared.kept(spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count(), "cleaned")
    assert not shuffled() - before and spark.conf.get(shared.CLEANUP) == setting
    assert table.count() == 70
