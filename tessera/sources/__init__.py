"""Readers, writers and external tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", delimiter).csv(path)


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pipe-delimited lines that end in a delimiter: one placeholder column is read and dropped."""
    padded = T.StructType([*schema.fields, T.StructField("__placeholder", T.StringType())])
    return spark.read.schema(padded).option("sep", "|").csv(path).drop("__placeholder")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def from_path(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """SQL over a path literal."""
    return spark.sql(f"select * from {kind}.`{path}`")


def external_table(spark: SparkSession, name: str, path: str, kind: str = "parquet", **options: str) -> None:
    """A temporary view over files, the counterpart of an external table."""
    listed = ", ".join(f"{k} '{v}'" for k, v in ({"path": path} | options).items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING {kind} OPTIONS ({listed})")


def s3_options(access_key: str, secret_key: str, endpoint: str | None = None, region: str | None = None, path_style: bool = False) -> dict[str, str]:
    """Session settings for an S3-compatible object store."""
    conf = {"spark.hadoop.fs.s3a.access.key": access_key, "spark.hadoop.fs.s3a.secret.key": secret_key, "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower()}
    return conf | ({"spark.hadoop.fs.s3a.endpoint": endpoint} if endpoint else {}) | ({"spark.hadoop.fs.s3a.endpoint.region": region} if region else {})


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "snappy", column_options: dict[str, dict[str, str]] | None = None) -> None:
    """Write Parquet; ``column_options`` maps columns to writer options such as ``parquet.bloom.filter.enabled``."""
    writer = df.write.mode(mode).option("compression", compression)
    for column, options in (column_options or {}).items():
        for key, value in options.items():
            writer = writer.option(f"{key}#{column}", value)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    df.write.mode(mode).option("header", header).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def insert_into(df: DataFrame, path: str, schema: T.StructType) -> DataFrame:
    """Append rows to a Parquet table, cast to its schema; returns one row with ``count``. A timestamp put into a long gives nanoseconds."""
    from pyspark.sql import Observation

    kinds = dict(df.dtypes)

    def cast(f: T.StructField):
        if isinstance(f.dataType, T.LongType) and kinds[f.name].startswith("timestamp"):
            return (F.unix_micros(F.col(f.name).cast("timestamp")) * 1000).alias(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)

    seen = Observation()
    df.select(*[cast(f) for f in schema]).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return df.sparkSession.range(1).select(F.lit(seen.get["n"]).cast("long").alias("count"))


def split_shards(df: DataFrame, path: str, shards: int, keys: Sequence[str] = ()) -> None:
    """Rewrite a table as evenly filled files, by hash of keys where given."""
    (df.repartition(shards, *keys) if keys else df.repartition(shards)).write.parquet(path)


def information_schema(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """(table_name, column_name, ordinal_position, data_type, is_nullable) of tables and views."""
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable) for t in tables for i, f in enumerate(spark.table(t).schema, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position bigint, data_type string, is_nullable boolean")


def show_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select("tableName", "isTemporary")
