"""Retrieval quality: recall@k, nDCG@k and MRR of ranked results against relevant ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, ndcg, mrr); ``results`` has (query_id, id, rank), ``relevant`` (query_id, id)."""
    pairs = relevant.distinct()
    hits = results.where(F.col("rank") <= k).join(pairs, ["query_id", "id"])
    return _measured(hits, pairs.groupBy("query_id").agg(F.count("*").alias("n")), k)


def quality_by_label(results: DataFrame, queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """The same where a row is relevant to the queries of its label; ``queries`` has (query_id, label), ``rows`` (id, label), each id once.

    Relevant rows are counted by label, and only results are looked up, so the
    pairs of queries and relevant rows are never made.
    """
    ranked = results.where(F.col("rank") <= k).join(queries.withColumnRenamed("label", "wanted"), "query_id").join(rows, "id")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return _measured(ranked.where("label = wanted"), queries.join(counts, "label").select("query_id", "n"), k)


def _measured(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``hits`` (query_id, rank) are the relevant results, ``wanted`` (query_id, n) counts the relevant rows."""
    gained = hits.groupBy("query_id").agg(F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = wanted.join(gained, "query_id", "left")
    zero = F.lit(0.0)
    return joined.select("query_id", F.coalesce(F.col("h") / F.col("n"), zero).alias("recall"), F.coalesce(F.col("dcg") / ideal, zero).alias("ndcg"), F.coalesce(1 / F.col("first"), zero).alias("mrr"))
