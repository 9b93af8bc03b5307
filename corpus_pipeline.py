"""Five corpus operators in a row, from ``documents`` to encoded documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of ``documents``.

Null and empty texts have fewer than the 20 words that the first stage asks for,
so they end there. Rows without a ``doc_id`` pass the stages on lines and on near
duplicates unchanged, and are judged by their own text in the others; rows that
share a ``doc_id`` are one document to these two stages and rows by themselves to
the others. Further columns are carried along, whatever their names, but for
``n_tokens`` and ``ids``, which the last stage sets. Empty tables give empty
results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from tessera.llm.storage import materialize
from tessera.session import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.keep_good(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those with nothing left go."""
    cut = line_dedup.dedup_lines(docs, ("__lines", "__removed"))
    left = cut.where((F.col("__removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    groups = jaccard_join.similar_groups(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids instead of their texts."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", unique_lines),
    ("jaccard_join", unique_documents),
    ("decontaminate", no_benchmarks),
    ("bpe", encoded),
]

#: SimHash, alignment and BPE have no SQL form; tests/llm/test_hard_cases.py compares each stage and the run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
