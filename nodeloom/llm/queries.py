"""The registered queries of the training-data operators, and the SQL where SQL can say the same.

Each query applies its operator with production parameters to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import byte_bpe, embedding_dedup, media, packing, pii, quality, simhash, suffix_dedup, token_counts, toxicity
from nodeloom.llm._common import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).drop("text")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, radius=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality")).drop("text")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, _tokenizer("piece_bpe_32k.model"), limit=4096).drop("text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.best_fit_packing(docs, _tokenizer("word_bpe_49k.json"), size=4096, separator=1)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_media=True).drop("text")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.byte_bpe(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash_dedup, op3_quality, op4_embedding_dedup, op5_token_counts, op6_best_fit_packing, op7_suffix_dedup, op8_pii, op9_media_columns, op10_byte_bpe)}

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach AS (
            SELECT vec_id AS x, vec_id AS y FROM embeddings
            UNION
            SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
        ), component AS (
            SELECT x, min(y) AS component_id FROM reach GROUP BY x
        ), counted AS (
            SELECT x, count(*) AS n FROM links GROUP BY x
        )
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN component c ON c.x = e.vec_id LEFT JOIN counted k ON k.x = e.vec_id
    """,
    "op7_suffix_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS h FROM documents
        ), windows AS MATERIALIZED (
            SELECT k, i, md5(array_slice(h, i + 1, i + 400)) AS m
            FROM (SELECT k, h, unnest(range(0, octet_length(h) - 399)) AS i FROM d WHERE octet_length(h) >= 400)
        ), repeated AS (
            SELECT k, i FROM windows JOIN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1) USING (m)
        ), marked AS (
            SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM repeated
        ), runs AS (
            SELECT k, min(i) AS a, max(i) + 400 AS b FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM marked) GROUP BY k, run
        ), gaps AS (
            SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS z FROM runs
        ), cut AS (
            SELECT d.k, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
                string_agg(CASE WHEN a > z THEN hex(array_slice(h, z + 1, a)) ELSE '' END, '' ORDER BY a) AS head
            FROM gaps JOIN d ON d.k = gaps.k GROUP BY d.k
        )
        SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
            sha256(CASE WHEN removed IS NULL THEN h ELSE unhex(head || CASE WHEN octet_length(h) > last THEN hex(array_slice(h, last + 1, octet_length(h))) ELSE '' END) END) AS kept_sha256
        FROM d LEFT JOIN cut ON cut.k = d.k
    """,
}
