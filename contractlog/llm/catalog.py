"""Queries of the training-data operators, with DuckDB SQL where SQL can express them.

Queries without SQL are held against brute force, exact round trips or held-out labels in
tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from contractlog.llm import byte_bpe, chat_format, exact_dedup, language_id, mixing, ngram_join, quality, token_rollup, toxicity, vector_join
from contractlog.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(table(spark, sf_dir, "conversations").unionByName(chat_format.probe_rows(spark)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.query(table(spark, sf_dir, "documents"))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of documents by three tokenizers; op4_token_rollup has the two that SQL can count."""
    return token_rollup.whole(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.train(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce("text", ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def op8_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.links(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.counted(table(spark, sf_dir, "documents"))
    return mixing.occurrences(docs, mixing.plan(docs, tokens_col="tokens"), tokens_col="tokens")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_quality": op3_quality,
        "op4_token_rollup": op4_token_rollup,
        "token_totals": token_totals,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_vector_join": op8_vector_join,
        "op9_mixing": op9_mixing,
        "op10_ngram_join": op10_ngram_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op1_chat_format": chat_format.DIGESTS_SQL,
        "op4_token_rollup": token_rollup.QUERY_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op9_mixing": mixing.OCCURRENCES_SQL,
    }
