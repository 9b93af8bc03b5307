"""All queries of the relational and retrieval operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import functions
from tessera.plans import frames, pack, retrieval, tpch
from tessera.session import register_tables

Query = Callable[[SparkSession, str], DataFrame]


def _sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_tables(spark, sf_dir)
        functions.register(spark)
        return spark.sql(text)

    return run


def queries() -> dict[str, Query]:
    return {name: _sql(text) for name, text in tpch.SQL.items()} | {name: _sql(pack.spark_sql(name)) for name in pack.SQL} | frames.QUERIES | retrieval.QUERIES


def oracle_sql() -> dict[str, str]:
    return tpch.SQL | {name: text for name in pack.SQL if (text := pack.oracle_sql(name))} | retrieval.ORACLE_SQL
