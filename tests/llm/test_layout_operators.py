"""Sharding, token files, packing, pages, transcripts, pipeline."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavemill.llm import dom, frames, packing, pages, sharding, tokens, transcripts
from wavemill.llm.queries import tokenizer
from wavemill.llm.shared import components, fresh_folder, kept

ODD_TEXTS = ["", " ", "a\x1cb c", "<|endoftext|> x<|startoftext|>", "It's  I'LL\n12.5% é é ΟΔΟΣ 漢字 a b ½", "STRASSE straße!! É.", "x_y a-b (c) d)", "näive"]


def whole_ids(text, end):
    library = tokens.encoder(tokenizer()).library
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_page_texts_travel_compressed():
    import pyarrow as pa

    blocks = [f"Block {k} of an article, with some words that recur: été, {k % 7}." for k in range(60)]
    html = "<html><body><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body></html>"
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array([1, 2, None]), "url": ["u"] * 3, "row": [1, 2, 3], "html": [html, "", None]})
    (sent,) = pages.packed(batch)
    assert sent.column("packed").nbytes < len("\n\n".join(blocks)) / 2
    sent = sent.append_column("drop", pa.array([[0, 59, 7], None, []], pa.list_(pa.int32())))
    (got,) = pages.unpacked(sent)
    assert got.column("text").to_pylist() == ["\n\n".join(b for k, b in enumerate(blocks) if k not in (0, 7, 59)), "", ""]


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(500, 500), (7, 3)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_two_tables(spark, monkeypatch):
    """Links that one task can hold need no rounds of shuffles; more of them give the same result."""
    from wavemill.llm import shared

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 - k, 999 - k) for k in range(60)]
    links, names = spark.createDataFrame(edges, "a long, b long"), []
    write = shared.kept
    monkeypatch.setattr(shared, "kept", lambda df, name: names.append(name) or write(df, name))
    few = {(r["node"], r["component"]) for r in components(links).collect()}
    assert names == ["links", "components"]
    monkeypatch.setattr(shared, "LINKS", 20)
    assert {(r["node"], r["component"]) for r in components(links).collect()} == few
    least = {x: min(x, y) for a, b in edges if a != b for x, y in ((a, b), (b, a))}
    for _ in edges:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert few == set(least.items())


def test_encoding_by_pieces_is_exact(sample):
    coder = tokens.Encoder(tokenizer())
    assert coder.by_piece
    texts = ODD_TEXTS + [r["text"] for r in sample.limit(60).collect()]
    for _ in range(2):
        assert coder.encode(texts) == [coder.whole(t) for t in texts]
    assert coder.encode([None]) == [b""]


def check_shards(rows, got, shards):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_near_equal_and_keep_equal_texts(docs_of):
    rng = random.Random(2)
    rows = [(k, "x" * rng.randint(0, 300) + str(rng.randint(0, 2500))) for k in range(4000)]
    rows += [(5000 + k, "a copy " * 20) for k in range(2500)]  # a third of all bytes
    rng.shuffle(rows)
    got = sharding.assign(docs_of(rows), 8).collect()
    check_shards(rows, got, 8)
    sizes = Counter()
    where = defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert max(abs(s - mean) for s in sizes.values()) < 0.06 * mean
    assert sum(len(s) > 1 for s in where.values()) <= 1 + 7


def test_shards_of_odd_rows(docs_of, spark):
    rows = [(None, None), (1, ""), (1, ""), (1, ""), (2, "é")]
    check_shards(rows, sharding.assign(docs_of(rows).withColumn("size", F.lit("x")), 16).collect(), 16)
    assert sharding.assign(docs_of([]), 16).count() == 0
    folder = fresh_folder(spark, "shards")
    sharding.write_shards(docs_of(rows), folder, 4)
    assert spark.read.parquet(folder).count() == len(rows)


def test_token_files_round_trip(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    rows = [(k * 7 % 101, t) for k, t in enumerate(ODD_TEXTS)] + [(1000 + k, "word " * rng.randint(0, 3000)) for k in range(40)]
    rows += [(None, None), (1000, "again"), (1000, "again")]
    folder = fresh_folder(spark, "token-files")
    frames.write_tokens(docs_of(rows).repartition(3), folder, tokenizer(), 2)
    got = frames.read_tokens(spark, folder).collect()
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    want = Counter((d, len(x := whole_ids(t, 2)), zlib.crc32(x.tobytes())) for d, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    some = frames.read_tokens(spark, folder, [1005, 7]).collect()
    assert sorted(r["doc_id"] for r in some) == [7, 1005] and set(some) <= set(got)
    empty = fresh_folder(spark, "token-files")
    frames.write_tokens(docs_of([]), empty, tokenizer(), 2)
    assert frames.read_tokens(spark, empty).count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    import zstandard

    path, docs = tmp_path / "x.zst", [(k, np.arange(k * 4000, dtype="<u4") % 50_000) for k in range(30)]
    with path.open("wb") as f:
        writer = frames.Writer(f, 2)
        for d, ids in docs:
            writer.add(d, ids)
        writer.close()
    raw = path.read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(ids.astype("<u2").tobytes() for _, ids in docs)
    with path.open("rb") as f:
        reader = frames.Reader(f, len(raw))
        opened = []
        plain = reader.frame_ids
        reader.frame_ids = lambda k: opened.append(k) or plain(k)
        (d, _, ids), = reader.documents(np.array([12]))
        assert d == 12 and ids.tolist() == docs[12][1].tolist() and len(opened) == 1 < len(reader.packed)
    broken = bytearray(raw)
    broken[int(reader.begin[1]) - 3] ^= 1
    path.write_bytes(bytes(broken))
    with path.open("rb") as f, pytest.raises((ValueError, zstandard.ZstdError)):
        frames.Reader(f, len(raw)).frame_ids(0)


def test_schedule_is_exact_and_monotone():
    rng = random.Random(4)
    for _ in range(100):
        totals = [rng.choice([0, 1, 2, 3, 10, 1000, rng.randint(0, 20_000)]) for _ in range(rng.randint(1, 8))]
        s = packing.Schedule(totals, rng.choice([4, 100, 2048]))
        before = [0] * len(totals)
        for m in range(s.all // s.window + 3):
            now, full = s.served(m), min(m * s.window, s.all)
            assert sum(now) == full and all(a >= b for a, b in zip(now, before))
            assert all(abs(a * s.all - full * n) <= (1 + len(totals) / 2) * s.all for a, n in zip(now, totals))
            before = now
        assert before == totals


def test_packing_holds_every_id_once_in_full_sequences(docs_of):
    rng = random.Random(5)
    rows = [(k, "some words here " * rng.randint(0, 60), f"s{min(4, k % 9)}") for k in range(300)]
    rows += [(1000, None, None), (1001, "", "s0"), (None, "no id", "s1"), (2000, "twice", "s1"), (2000, "twice", "s1"), (1002, "long text " * 4000, "s2")]
    got = packing.pack(docs_of(rows), tokenizer(), 1, sequence=64, window_sequences=4).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, own in by_sequence.items():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        assert sum(n for _, n in own) == 64 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for d, t, s in rows[:40] + rows[300:303] + rows[-1:]:
        ids, own = whole_ids(t, 1), sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in own) == len(ids)
    assert sum(r["length"] for r in got if r["doc_id"] == 2000) == 2 * len(whole_ids("twice", 1))
    total = sum(r["length"] for r in got)
    share = Counter()
    for r in got:
        share[r["source"]] += r["length"] / total
    windows = defaultdict(Counter)
    for r in got:
        windows[r["sequence_id"] // 4][r["source"]] += r["length"]
    for w, own in windows.items():
        if w < max(windows):
            assert all(abs(own[s] - 256 * share[s]) <= 2 + len(share) for s in share)
    assert packing.pack(docs_of([]), tokenizer(), 1).count() == 0


PAGE = (
    "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<div class=note>Always the same words</div><div class=body><h2>{t}</h2><p>First &amp; best {t}<br>of\n all<p>Second {t}</div>"
    "<div class='comments'><p>I like {t}</div><footer>c</footer></body></html>"
)


def test_blocks_of_odd_html():
    assert dom.blocks(None) == dom.blocks("") == dom.blocks("<script>x<p>y") == dom.blocks("<!-- a") == []
    texts = lambda h: [b[1] for b in dom.blocks(h)]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("1 < 2 &lt;p&gt; &#233;") == ["1 < 2 <p> é"]
    assert texts("</p></div>x<p/>y<") == ["x", "y<"]
    assert texts("<p title=it's>a</p><p class='x>y'>b") == ["a", "b"]


def test_class_words_never_discard_the_article():
    own = lambda h: [b[1] for b in pages.candidates(dom.blocks(h))]
    art, side = "<article><h1>T</h1><p>The article's own text</article>", "<div class=sidebar><p>Other things to read</div>"
    assert own(f"<div class='layout has-sidebar'>{art}{side}</div>") == ["T", "The article's own text"]
    assert own(f"<p>Skip</p><main class=no-comments>{art}</main>{side}") == ["T", "The article's own text"]
    assert own(f"<main><h2>News</h2>{art.replace('article>', 'article class=share-enabled>', 1)}{side}</main>") == ["News", "T", "The article's own text"]
    long = "<p>Words of the article, many of them, over and over. " * 5
    assert len(own(f"<div id=page-with-menu><div class=body>{long}</div>{side}</div>")) == 5
    # Beside an article, marked elements stay marked, also with an <article> for each comment.
    assert own(f"{art}<div id=comments><article>I like it</article></div>") == ["T", "The article's own text"]
    assert own("<main><p>The text</main><div id=comments><article>I like it</article></div>") == ["The text"]
    assert own(f"<div class=body>{long}</div>{side}<div class=cookie-notice>We use cookies</div>") == own(long)


def test_tree_matching_pairs_nodes_in_order():
    a, b = dom.tree(["/r/n.x", "/r/d.a/p", "/r/f"]), dom.tree(["/r/d.b/p", "/r/f"])
    score, pairs = dom.match(a, b)
    assert (("r", "d.a", "p"), ("r", "d.b", "p")) in pairs and (("r", "f"), ("r", "f")) in pairs
    assert not any(p[0][-1] == "n.x" for p in pairs)


def test_wrapper_keeps_slots_and_drops_the_template(spark):
    rows = [(k, f"http://www.a.org/{k}", PAGE.format(t=f"topic {k}")) for k in range(8)]
    rows += [(100, "http://b.org/x", PAGE.format(t="alone")), (101, None, None), (102, "", ""), (103, "http://[bad", "<p>x"), (None, "http://a.org/z", PAGE.format(t="topic 1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    out = pages.extract(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for k in range(8):
        assert got[k] == f"topic {k}\n\nFirst & best topic {k} of all\n\nSecond topic {k}"
    assert got[100].startswith("Always the same words\n\nalone") and got[None] == got[1]
    assert got[101] == got[102] == "" and got[103] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_a_host_of_copies_keeps_its_article(spark):
    page = "<nav>{k}</nav><article><h1>T</h1><p>Same text</article>"
    rows = [(k, "http://spam.org/a", page.format(k=k)) for k in range(9)]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {"T\n\nSame text"}
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def conversations(spark, n=60, long=400):
    rng, rows = random.Random(6), []
    for c in range(n):
        for t in range(long if c == 0 else rng.randint(1, 9)):
            role = "system" if t == 0 and c % 5 == 0 else ("user", "assistant")[(t - (c % 5 == 0)) % 2]
            rows.append((c, t, role, "\n".join("word " * rng.randint(1, 30) for _ in range(rng.randint(1, 3)))))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered_and_splitting_changes_nothing(spark):
    table = conversations(spark)
    raw = kept(transcripts.rendered_raw(table), "raw")
    model = transcripts.fit(raw)
    got = {(r["conv_id"], r["turn"]): r for r in transcripts.parse(raw.withColumn("hash", F.lit("x")), model).collect()}
    truth = {(r["conv_id"], r["turn"]): r for r in raw.collect()}
    right = sum(got[k]["roles"][0] == truth[k]["role"] for k in truth)
    assert len(got) == len(truth) and right >= 0.95 * len(truth)
    for c in (0, 1, 5):  # one conversation at a time, without partitions
        keys = sorted(k for k in truth if k[0] == c)
        seen = [[s for s, _ in transcripts.symbols(truth[k]["text"])] for k in keys]
        path = model.path([s for own in seen for s in own], None, None)
        for k, own in zip(keys, seen):
            states, path = path[: len(own)], path[len(own) :]
            assert got[k]["roles"] == [transcripts.ROLES[s // 2] for s in states]
            assert got[k]["n_starts"] == sum(s % 2 == 0 for s in states) == got[k]["rendered"].count("<|")


def test_transcripts_of_odd_rows(spark):
    model = transcripts.fit(transcripts.rendered_raw(conversations(spark, 10, 5)))
    rows = [(None, 0, None), (None, None, "User: hi"), (1, 0, ""), (1, 1, "[ai] x\n\n"), (1, 1, "[ai] x\n\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    assert transcripts.parse(df, model).count() == len(rows)
    assert transcripts.parse(df.where("false"), model).count() == 0
    none = transcripts.fit(df.where("false").withColumn("role", F.lit("user")))
    assert transcripts.parse(df, none).count() == len(rows)


def test_markers():
    kind = lambda line: transcripts.describe(line, False)[0][0]
    assert [kind(x) for x in ("User: a", "[ai] b", "### Answer:", "**Q:** c", "<|system|>", "assistant")] == [1, 2, 2, 1, 0, 2]
    assert [kind(x) for x in ("a house", "users: x", "", "  ")] == [3, 3, 4, 4]


def test_pipeline_stages(spark, sample):
    d, docs, names = "/root/testdata/sf0.001", sample, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = kept(stage(spark, docs, d), name)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before
        assert (after == before) == (name == "line_dedup") or name == "near_duplicates"
    tokens_in = sum(len(whole_ids(r["text"], 1)) for r in docs.collect())
    assert corpus_pipeline.run(spark, d).agg(F.sum("length")).first()[0] == tokens_in


def test_pipeline_without_rows(spark, sample):
    docs = sample.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_near_duplicates_go_row_by_row(spark, docs_of):
    """Two texts under one doc_id, texts without doc_id, repeated rows, empties and clashing names."""
    a, near, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "wvu")
    near = a + " more"
    rows = [(1, a), (2, near), (2, other), (3, None), (3, None), (4, ""), (5, a), (None, near), (None, "x " + other), (None, "lone text of its own"), (6, "twice the same row here"), (6, "twice the same row here")]
    docs = docs_of(rows).withColumn("worse", F.lit(1)).withColumn("component", F.lit("c")).withColumn("tag", F.lit(2))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = [(1, a), (2, other), (3, None), (3, None), (4, ""), (None, "lone text of its own"), (6, "twice the same row here")]
    assert got == sorted(want, key=str)
