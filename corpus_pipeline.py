"""A training-data pipeline over ``documents``: quality, exact dedup, near-dedup, mixing, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. A stage judges all its input; all but the last return the columns of ``documents``, extra ones
included. doc_id names a document: what is decided for an id holds for all rows that repeat it. Rows with a null doc_id
pass every decision that is taken by id. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labledger.llm import bpe, exact_dedup, mixing, quality, setsketch
from labledger.llm.common import ready, written
from labledger.llm.queries import WORD_BPE, table

KEPT_TOKENS = 0.8  # expected share of the tokens that the mixed sample holds


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows whose id wasn't dropped. The dropped ids are written, so the planner knows their size when it joins."""
    dropped = written(judged.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return _without(docs, quality.classify_quality(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return _without(docs, exact_dedup.exact_groups(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, Jaccard similarity of 0.8 or more."""
    return _without(docs, setsketch.minhash_components(docs, words=5, percent=80))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow tempered source, language and topic shares."""
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), F.col("lang"),
                       mixing.topic().alias("topic"), mixing.word_count().alias("n_tokens"))
    return mixing.mix_sources(held, ["source", "lang", "topic"], keep=KEPT_TOKENS).filter("sampled").select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' BPE ids, their number and the text that they decode to, in place of the text."""
    return bpe.encode_decode(docs, WORD_BPE, outputs=("ids", "n_tokens", "decoded"))


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_stage), ("minhash_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier, the sketches, the sampling hash and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
