"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and then by its first tokens, where a token
with a digit counts as a variable.  In a leaf, a token that enough lines have at one place is constant
and any other one is a variable field, so lines that differ in variable fields share a template.
A template with mostly constant tokens that lines of several documents have is recurring: its
first line (smallest doc_id, then place) stays and all others are dropped.

Leaves, tokens and templates are counted with plain aggregates, and only leaves with enough lines
are looked into.  Equal lines are counted once with a weight, so a line of a third of all documents is
one row.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.shared import kept, one_by_one
from wavemill.llm.words import pieces

#: First tokens that are levels of the tree.
DEPTH = 3
#: Documents that make a template recurring, and lines that make a token constant.
LEAST_DOCUMENTS = 3
#: Lines with fewer tokens are never dropped.
LEAST_TOKENS = 5
#: Share of the tokens after the first ones that must be constant.
LEAST_CONSTANT = 0.7

GAP = r"[\x20\x09-\x0D]+"


def tokens(line):
    return F.filter(F.split(line, GAP), lambda t: t != "")


def leaf(t):
    """Hash of the node a line with tokens ``t`` ends in: their number and the masked first ones."""
    lead = F.transform(F.slice(t, 1, DEPTH), lambda x: F.when(x.rlike("[0-9]"), F.lit("<*>")).otherwise(x))
    return F.xxhash64(F.size(t), lead)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, record): the key is equal for repeated rows only and usable without doc_id."""
    doc_id = F.col("doc_id").cast("long")
    key = F.struct(doc_id.alias("id"), F.xxhash64("text").alias("hash"))
    return docs.select(key.alias("key"), doc_id.alias("doc_id"), "text", F.struct(*docs.columns).alias("record"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(key, place, leaf) of all lines with enough tokens; each line is cut into tokens once."""
    lines = docs.select("key", F.posexplode(F.transform(F.split("text", "\n"), tokens)).alias("place", "t"))
    return lines.where(F.size("t") >= LEAST_TOKENS).select("key", "place", leaf(F.col("t")).alias("leaf"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(key, places): the line numbers to drop from each row that loses any."""
    docs = keyed(docs).select("key", "doc_id", "text")
    narrow = kept(occurrences(docs), "leaves")
    leaves = narrow.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= LEAST_DOCUMENTS)
    flagged = narrow.join(leaves.select("leaf"), "leaf").groupBy("key").agg(F.collect_set("place").alias("wanted"))
    # Whole texts move once, by row; only lines in shared leaves go on.
    lines = docs.join(flagged, "key").select("doc_id", F.col("key.hash").alias("hash"), "text", "wanted")
    lines = one_by_one(lines, picked, "doc_id long, hash long, place int, line string")
    lines = lines.withColumn("key", F.struct(F.col("doc_id").alias("id"), "hash"))
    lines = lines.select("key", "doc_id", "place", "line", leaf(tokens(F.col("line"))).alias("leaf"), F.xxhash64("line").alias("same"))
    lines = kept(lines.select("key", "doc_id", "place", "leaf", "same", "line"), "lines")

    distinct = lines.groupBy("leaf", "same").agg(F.min("line").alias("line"), F.count("*").alias("weight"))
    parts = distinct.select("leaf", "same", "weight", F.posexplode(tokens(F.col("line"))).alias("at", "token"))
    parts = parts.where(F.col("at") >= DEPTH).withColumn("spot", F.xxhash64("leaf", "at", "token"))
    support = parts.groupBy("spot").agg(F.sum("weight").alias("support")).where(F.col("support") >= LEAST_DOCUMENTS)
    marked = parts.select("leaf", "same", "at", "spot").join(support, "spot", "left")
    templates = marked.groupBy("leaf", "same").agg(
        F.sum(F.when(F.col("support").isNotNull(), F.xxhash64("at", "spot").cast("decimal(38,0)"))).alias("constants"),
        F.count("support").alias("n_constant"),
        F.count("*").alias("n"),
    )
    templates = templates.where(F.col("n_constant") >= F.col("n") * LEAST_CONSTANT)
    templates = templates.select("leaf", "same", F.xxhash64("leaf", "constants").alias("template"))

    found = lines.select("key", "doc_id", "place", "leaf", "same").join(templates, ["leaf", "same"])
    by_doc = found.groupBy("template", "doc_id").agg(F.min(F.struct("doc_id", "key", "place")).alias("first"))
    recurring = by_doc.groupBy("template").agg(F.min("first").alias("first"), F.count("*").alias("documents"))
    recurring = recurring.where(F.col("documents") >= LEAST_DOCUMENTS).select("template", "first")
    again = found.join(recurring, "template").where(F.struct("doc_id", "key", "place") > F.col("first"))
    return again.groupBy("key").agg(F.collect_set("place").alias("places"))


def picked(batch: pa.RecordBatch):
    """The wanted lines of each text, a row each."""
    for part in pieces(batch, "text"):
        out = []
        for doc_id, key, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "hash", "text", "wanted"))):
            own = text.split("\n")
            out += [(doc_id, key, k, own[k]) for k in wanted]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "hash", "place", "line"])


def without(text: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for t, p in zip(text, places):
        if p is not None and t is not None:
            drop = set(p)
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop)
        out.append(t)
    return pd.Series(out, dtype=object)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns, texts without lines of recurring templates but for the first such line.

    Lines end at \\n.  Null texts stay null, a text can become empty, repeated rows lose the same
    lines, an empty table stays empty.  ``n_chars``, if there is such a column, follows the text.
    """
    drops = dropped_lines(docs)
    rows = keyed(docs).select("key", "record").join(drops, "key", "left")
    rows = rows.withColumn("kept", F.pandas_udf(without, "string")(F.col("record.text"), F.col("places")))
    record = F.col("record").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        record = record.withField("n_chars", F.when(F.col("places").isNull(), F.col("record.n_chars")).otherwise(length))
    return rows.select(record.alias("record")).select("record.*")
