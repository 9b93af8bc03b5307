"""Session construction and table loading."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def get_spark(app_name: str = "tessera", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    On a cluster leave ``master`` unset: whatever spark-submit configured wins.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or "SPARK_REMOTE" not in os.environ:
        builder = builder.master(master) if master else builder
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder; on a cluster that would be a folder of one machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table of that name below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> None:
    """Register the tables of a directory as temporary views, for SQL."""
    for table in tables or TABLES:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
