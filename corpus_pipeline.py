"""Corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of ``documents``.  ``run`` writes every stage's rows to the shared folder and reads them back, so a
lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm import decontaminate, jaccard, lines, packing, toxicity
from wavemill.llm.queries import tokenizer
from wavemill.llm.shared import kept
from wavemill.registry import query
from wavemill.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for their first occurrence; every document stays."""
    return lines.deduplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id, and of repeated rows one.

    Rows are told by doc_id and a hash of the text, so that two texts under one doc_id, and texts without, are judged
    each.  Texts without words all stay.
    """
    name, order = ["__none", "__id", "__tag"], "__row"
    none, id_ = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    told = jaccard.rejects(docs).select(none.alias(name[0]), id_.alias(name[1]), F.col("tag").alias(name[2]), F.col("rows").alias("__rows"), F.col("goes").alias("__goes"))
    keyed = docs.withColumns({name[0]: none, name[1]: id_, name[2]: F.xxhash64("text")})
    left = keyed.join(told, name, "left").where("__goes IS NULL OR NOT __goes")
    one = F.row_number().over(Window.partitionBy(*name).orderBy(F.lit(0)))
    return left.withColumn(order, one).where(f"__rows IS NULL OR {order} = 1").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of token ids."""
    return packing.pack(docs, tokenizer(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are stages, so SQL cannot state the rows.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
