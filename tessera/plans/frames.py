"""Relational queries whose SQL text runs out of hand on large tables, as DataFrames; the text still states the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import load


def j10_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers and suppliers of a nation or of none, counted.

    The pairs of a key are the product of both sides, so each side is
    aggregated by key before the join instead of its pairs after it.
    """

    def side(table: str, nation: str, value: str) -> DataFrame:
        rows = load(spark, sf_dir, table).select(F.nullif(F.col(nation), F.lit(3)).alias("k"), value)
        return rows.groupBy("k").agg(F.count("*").alias("n"), F.max(value).alias("top"))

    a, b = side("customer", "c_nationkey", "c_custkey").alias("a"), side("supplier", "s_nationkey", "s_suppkey").alias("b")
    joined = a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")))
    return joined.select("a.k", (F.col("a.n") * F.col("b.n")).alias("pairs"), (F.col("a.top") + F.col("b.top")).alias("top"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"j10_null_safe": j10_null_safe}
