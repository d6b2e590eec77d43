"""Main text of web pages by wrapper induction over the pages of a host.

Every page is read into blocks of text, each with the label path of its element; same-label
siblings are one node, as an iterator of a wrapper.  The distinct trees of a host are aligned with
the host's most frequent tree by simple tree matching, which names every node of every page after a
node of the wrapper.  A node that has one and the same text on nearly all pages that have it, and
they are many, is constant and belongs to the template; all other nodes are varying slots.  The main text
is what slots hold that are not beside the article: inside <article> or <main> where a
page has one, else anywhere in the body.  Headings stay, and pages with equal candidate texts count
as one, so a host full of copies has no constant article.

Trees and hashes of texts are counted per host with plain aggregates, so a host with a third of all
pages is never gathered; only the extracted texts move, once, to meet the numbers of their constant
blocks.
"""

from __future__ import annotations

import json
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import dom
from wavemill.llm.shared import kept, one_by_one
from wavemill.llm.words import pieces

#: A text is constant if at least so many distinct pages of the host, and this share of them, have it,
#: and if it makes up this share of all texts of its node.
LEAST_PAGES, LEAST_SHARE, LEAST_OF_NODE = 4, 0.5, 0.9

BLOCKS = "row long, host long, page long, tree long, skeleton string, path long, text long, at int"


def hash64(text: str) -> int:
    return np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))).view(np.int64).item()


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def candidates(found: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str, bool, bool]]:
    """Blocks that are not beside the article, in the article where the page has one."""
    scope = any(b[3] and b[2] for b in found)
    return [b for b in found if b[2] and b[3] >= scope]


def page_key(found: list[tuple[str, str, bool, bool]]) -> int:
    return hash64("\n".join(b[1] for b in candidates(found)))


def skeleton(found: list[tuple[str, str, bool, bool]]) -> str:
    return json.dumps(dom.tree(list(dict.fromkeys(b[0] for b in found))), ensure_ascii=False)


def sketch(batch: pa.RecordBatch):
    """A row for each candidate block but headings, by hashes; the tree goes with a page's first row."""
    for part in pieces(batch, "html", 1 << 20):
        out = []
        for row, url, html in zip(*(part.column(c).to_pylist() for c in ("row", "url", "html"))):
            found = dom.blocks(html)
            host, page, tree = hash64(host_of(url)), page_key(found), skeleton(found)
            number, shown = hash64(tree), tree
            for at, (path, text, *_) in enumerate(candidates(found)):
                if not heading(path):
                    out.append((row, host, page, number, shown, hash64(path), hash64(text), at))
                    shown = None
        kinds = (*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.int32())
        cols = list(zip(*out)) or [()] * 8
        names = ["row", "host", "page", "tree", "skeleton", "path", "text", "at"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def aligned(batch: pa.RecordBatch):
    """Names of a tree's nodes in the host's wrapper, a row each."""
    for host, number, own, main in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "skeleton", "main"))):
        pairs = dom.match(json.loads(own), json.loads(main))[1]
        if pairs:
            a, b = ([hash64("/" + "/".join(p[k])) for p in pairs] for k in (0, 1))
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n), pa.array([number] * n), pa.array(a), pa.array(b)], ["host", "tree", "path", "node"])


def constants(rows: DataFrame) -> DataFrame:
    """(row, drop): the numbers of the candidate blocks of a page that belong to its host's template."""
    sizes = rows.groupBy("host", "page").agg(F.count("*")).groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    trees = rows.where("skeleton IS NOT NULL").groupBy("host", "tree", "skeleton").agg(F.count("*").alias("n"))
    main = trees.groupBy("host").agg(F.max(F.struct("n", "tree", "skeleton")).alias("main")).select("host", F.col("main.skeleton").alias("main"))
    names = one_by_one(
        trees.join(sizes.select("host"), "host").join(main, "host").select("host", "tree", "skeleton", "main"),
        aligned,
        "host long, tree long, path long, node long",
    )
    names = kept(names, "page-nodes")
    counted = rows.groupBy("host", "tree", "path", "text").agg(F.count_distinct("page").alias("n"))
    named = counted.join(names, ["host", "tree", "path"], "left").withColumn("node", F.coalesce("node", "path"))
    total = named.groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    often = total.where(F.col("n") >= LEAST_PAGES).join(sizes, "host").where(F.col("n") >= F.col("pages") * LEAST_SHARE)
    nodes = total.groupBy("host", "node").agg(F.sum("n").alias("all"))
    fixed = often.join(nodes, ["host", "node"]).where(F.col("n") >= F.col("all") * LEAST_OF_NODE).select("host", "node", "text")
    fixed = named.join(fixed, ["host", "node", "text"]).select("host", "tree", "path", "text")
    hits = rows.join(fixed, ["host", "tree", "path", "text"])
    return hits.groupBy("row").agg(F.collect_set("at").alias("drop"))


def heading(path: str) -> bool:
    return path.rpartition("/")[2][:2] in dom.HEADING


def packed(batch: pa.RecordBatch):
    """The text of a page's candidate blocks, compressed by itself, as it is shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for part in pieces(batch, "html", 1 << 20):
        texts = ["\n\n".join(b[1] for b in candidates(dom.blocks(h))) for h in part.column("html").to_pylist()]
        data = pa.array([pack(t.encode()) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("row"), data], ["page_id", "url", "row", "packed"])


def unpacked(batch: pa.RecordBatch):
    """The texts without the blocks to drop.  White space inside a block is one space, so blocks can be told apart again."""
    unpack = zstandard.ZstdDecompressor().decompress
    for part in pieces(batch, "packed", 1 << 20):
        texts = [unpack(t).decode() for t in part.column("packed").to_pylist()]
        for k, drop in enumerate(part.column("drop").to_pylist()):
            if drop is not None:
                drop = set(drop)
                texts[k] = "\n\n".join(b for at, b in enumerate(texts[k].split("\n\n")) if at not in drop)
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages have the text "" and keep their row; pages without a readable host share
    one host; repeated rows stay and count as one page; other columns are left out.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("url", "html").alias("row"))
    rows = kept(one_by_one(pages.select("row", "url", "html"), sketch, BLOCKS), "page-blocks")
    drops = constants(rows)

    own = one_by_one(pages, packed, "page_id long, url string, row long, packed binary").join(drops, "row", "left")
    own = one_by_one(own.select("page_id", "url", "packed", "drop"), unpacked, "page_id long, url string, text string")
    return own.withColumn("n_chars", F.length("text").cast("long"))
