"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Text bytes whose packed data one bucket is to hold.
BUCKET_BYTES = 64 << 20


def bucket_count(docs: DataFrame, least: int, column: str = "text", spread: bool = True) -> int:
    """Buckets to deal a table's packed data to, so that each fits into a task's memory whatever the size of the table; with ``spread`` as many as a shuffle has partitions, at least."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if spread else 0, -(-size // BUCKET_BYTES))
