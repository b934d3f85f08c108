"""A corpus from raw documents to token ids: five stages, each one operator of contractlog.llm.

Each stage is a function of (spark, docs, sf_dir). run() writes what a stage returns as
Parquet into the shared folder and reads it again as the next stage's docs, so a lost
executor costs tasks of one stage only. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlog.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from contractlog.llm.common import Scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote accepts (score >= 0.7); the rest goes."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles join (Jaccard >= 0.75) the one with the least id."""
    return ngram_join.dedup(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by source weights of at least 98 % of the greatest entropy.

    Large sources are thinned and small ones repeated (at most four times): rows may repeat.
    """
    return mixing.mix(docs, mixing.plan(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, with digests of the ids and of what they decode to."""
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), offsets=False).drop("text")
    back = byte_bpe.decode(coded, text=False)
    return back.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", source_mixture),
    ("byte-level BPE", token_ids),
]

#: Trained votes, links between all near copies and merges by rank have no SQL; tests/llm/test_pipeline.py goes by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.tidy()
    return docs
