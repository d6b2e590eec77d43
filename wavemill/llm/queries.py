"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import align, decontaminate, dualtree, frames, jaccard, lines, minhash, packing, pages, search, sharding, toxicity, transcripts
from wavemill.llm.shared import fresh_folder
from wavemill.registry import query
from wavemill.sources.tables import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _components_sql(n: int) -> str:
    """Components of documents whose sets of n-word shingles are linked at 80 of 100, for distinct doc_ids."""
    return rf"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^ 	-
]+') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
                                        WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
                                        ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS s
    FROM cut
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN size p ON p.doc_id = x.doc_id JOIN size q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n
    HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least.component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN least USING (doc_id)
"""


@query("op12_bayes_minhash", f"SELECT *, doc_id = component_id AS kept FROM ({_components_sql(4)})")
def bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


RANKED_SQL = r"""
WITH cut AS (
    SELECT 'd' AS side, doc_id AS id, text FROM documents
    UNION ALL
    SELECT 'i', item_id, text FROM benchmark
), term AS (
    SELECT side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM cut
), own AS (
    SELECT id AS doc_id, t, count(*) AS tf FROM term WHERE side = 'd' GROUP BY id, t
), doc AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM own GROUP BY doc_id
), total AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM doc
), weight AS (
    SELECT t, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM own CROSS JOIN total GROUP BY t, n_docs
), score AS (
    SELECT i.id AS item_id, o.doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // l))))) AS BIGINT) AS score
    FROM (SELECT DISTINCT id, t FROM term WHERE side = 'i') i JOIN weight USING (t) JOIN own o USING (t) JOIN doc USING (doc_id) CROSS JOIN total
    GROUP BY i.id, o.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


@query("op13_dual_tree_search", RANKED_SQL)
def dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.alignment(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query("op5_token_frames")
def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    frames.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer(), end_id=2)
    return frames.read_tokens(spark, folder)


@query("op8_mixture_packing")
def mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), end_id=1)


@query("op9_jaccard_groups", _components_sql(5))
def jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_toxicity_scores")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_line_templates")
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept text of every document with counts of its lines."""
    docs = table(spark, sf_dir, "documents")
    before = docs.withColumn("n_lines", F.size(F.split("text", "\n")))
    out = lines.deduplicate_lines(before)
    kept_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", "n_lines", kept_lines.alias("n_kept"), "text")


@query("op3_sampled_shards")
def sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


@query("op6_wrapper_text")
def wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op10_transcript_roles")
def transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles read from raw transcripts of all conversations; the model learns from four fifths of them."""
    raw = transcripts.rendered_raw(table(spark, sf_dir, "conversations"))
    learn = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 != 0
    return transcripts.parse(raw, transcripts.fit(raw.where(learn)))


@query("op4_bm25_search")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as queries: every term, as often as the text has it."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 20 = 0"), by_frequency=True)
