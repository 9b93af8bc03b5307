"""Hybrid search: vector and text rankings fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.text import text_search
from tessera.operators.vector import search


def _ranked(df: DataFrame, id_column: str, order: Column) -> DataFrame:
    # the inputs are top-k lists of bounded length
    return df.select(F.col(id_column), F.row_number().over(Window.orderBy(order, id_column)).alias("rank"))


def reciprocal_rank_fusion(ann: DataFrame, fts: DataFrame, k_param: int = 60, top_k: int = 10, id_column: str = "id") -> DataFrame:
    """(id, _relevance_score) by the sum of 1 / (k_param + rank) over both lists, ranks from 1."""
    if k_param <= 0 or top_k <= 0:
        raise ValueError("k_param and top_k must be positive")
    lists = _ranked(ann, id_column, F.col("_distance").asc_nulls_last()).unionAll(_ranked(fts, id_column, F.col("_score").desc_nulls_last()))
    fused = lists.groupBy(id_column).agg(F.sum(1.0 / (k_param + F.col("rank"))).alias("_relevance_score"))
    return fused.orderBy(F.col("_relevance_score").desc(), id_column).limit(top_k)


def hybrid_search(
    table: DataFrame, vector: Sequence[float], query: str, k: int = 10, *, id_column: str = "id", vector_column: str = "vector",
    text_column: str = "text", metric: str = "l2", filter: str | Column | None = None, k_param: int = 60, oversample: int = 2,
) -> DataFrame:
    """The ``k`` best rows by both rankings, each taken ``oversample`` times as deep."""
    depth = k * oversample
    ann = search(table, vector, depth, id_column=id_column, vector_column=vector_column, metric=metric, filter=filter, columns=[id_column])
    fts = text_search(table, query, depth, text_column=text_column, id_column=id_column, filter=filter)
    return reciprocal_rank_fusion(ann, fts, k_param, k, id_column)
