"""The queries of this package and their SQL, for the registry at the repository top."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, jaccard_join, licenses, line_dedup, lm_score, pii, quality, suffix_dedup
from tessera.session import load


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rules_failed")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(load(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs)
    kept = F.sha2(F.coalesce("kept", F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 256)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("score", 4).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_jaccard_join": op5_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op1_decontaminate": op1_decontaminate,
    "op4_bpe": op4_bpe,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op10_chat_format": op10_chat_format,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op9_lm_score": op9_lm_score,
    "op6_quality_rules": op6_quality_rules,
}

_OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
p AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word),
b AS (SELECT prev, word, count(*) AS c FROM p WHERE prev IS NOT NULL GROUP BY prev, word HAVING count(*) >= 2),
s AS (
    SELECT p.doc_id, CASE WHEN b.c IS NOT NULL THEN ln(b.c / u1.c)
        ELSE ln(u2.c / (SELECT count(*) FROM t)) + CASE WHEN p.prev IS NULL THEN 0 ELSE ln(0.4) END END AS x
    FROM p JOIN u AS u2 ON u2.word = p.word LEFT JOIN u AS u1 ON u1.word = p.prev
    LEFT JOIN b ON b.prev = p.prev AND b.word = p.word
)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(sc, 0)::DOUBLE, 4) AS score
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, sum(x) AS sc FROM s GROUP BY doc_id) USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op9_lm_score": _OP9_SQL}
