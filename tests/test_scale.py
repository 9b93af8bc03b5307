"""Queries on tables of other keys, sizes and groups than the test data has, against their SQL."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, text, vector
from tessera.plans import registry


@pytest.fixture
def folder(sf_dir, tmp_path):
    """A folder of the test tables; ``replace(table, sql)`` puts the rows of a statement over them in place of a table."""

    def replace(table: str, sql: str) -> None:
        path = tmp_path / f"{table}.parquet"
        path.unlink(missing_ok=True)
        duckdb.sql(f"copy ({sql.replace('SRC', sf_dir)}) to '{path}'")

    for name in os.listdir(sf_dir):
        (tmp_path / name).symlink_to(f"{sf_dir}/{name}")
    return str(tmp_path), replace


def as_sql(spark, path: str, query: str) -> tuple[Counter, Counter]:
    """The rows of a query and of its SQL."""
    con = duckdb.connect()
    for name in os.listdir(path):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}/{name}'")
    found = registry.queries()[query](spark, path)
    wanted = con.sql(registry.oracle_sql()[query])
    assert found.columns == wanted.columns
    return Counter(map(tuple, found.collect())), Counter(wanted.fetchall())


def test_upsert_of_keys_that_repeat_or_are_mirrored(spark, folder):
    path, replace = folder
    rows = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from 'SRC/customer.parquet'"
    odd = "select * from (values (0::bigint, 'zero', 5, 0.0::double, 'BUILDING'), (-7, 'below', 5, 0.0, 'BUILDING'), (7, 'above', 5, 0.0, 'BUILDING'), (8, null, 5, 0.0, null)) as t"
    replace("customer", f"{rows} union all {rows} where c_custkey < 50 union all {odd}")
    found, wanted = as_sql(spark, path, "w11_upsert")
    assert found == wanted


def test_null_safe_join_counts_pairs_without_making_them(spark, folder):
    """4.8e10 pairs, which would take hours one by one; nulls are a key of their own."""
    path, replace = folder
    replace("customer", "select case when i % 3 = 0 then null else i end as c_custkey, [null, 3, 7, 7, 9][i % 5 + 1] as c_nationkey from range(400000) t(i)")
    replace("supplier", "select i as s_suppkey, [null, 3, 7, 8][i % 4 + 1] as s_nationkey from range(400000) t(i)")
    found = {(r["k"], r["pairs"], r["top"]) for r in registry.queries()["j10_null_safe"](spark, path).collect()}
    assert found == {(None, 160000 * 200000, 799992), (7, 160000 * 100000, 799996)}


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_batch_search_in_cells_equals_all_distances(spark, monkeypatch, metric):
    """Many cells, copies, near ties far from the origin, and values that overflow or are no numbers."""
    monkeypatch.setattr(vector, "CELL_ROWS", 200)
    monkeypatch.setattr(vector, "CELL_QUERIES", 15)
    monkeypatch.setattr(vector, "_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1500, 6))
    rows[300:600] = rows[:300]
    rows[600:900] = 1e6 + rows[:300] * 1e-3
    rows[900], rows[901], rows[902] = np.nan, np.inf, 1e200
    rows[903:950] = 0
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(1500, None), (1501, [1.0, 2.0])]
    df = spark.createDataFrame(table, "id bigint, vector array<double>")
    asked = [i for i in range(0, 1500, 20) if i != 900]
    found = vector.batch_search(df, df.where(F.col("id").isin(asked)).select(F.col("id").alias("query_id"), "vector"), 4, metric=metric).collect()
    got = {(r["query_id"], r["rank"]): r["id"] for r in found}
    want = {}
    with np.errstate(all="ignore"):
        for i in asked:
            d = vector._exact(rows, np.broadcast_to(rows[i], rows.shape), metric)
            best = [j for j in np.lexsort((np.arange(len(d)), d)) if not np.isnan(d[j])][:4]
            want |= {(i, n + 1): j for n, j in enumerate(best)}
    assert got == want


def test_batch_search_is_dealt_to_tasks(spark, folder):
    """A table of one file gives many cells, none of them large."""
    path, replace = folder
    replace("embeddings", "select vec_id + i * 10000 as vec_id, embedding, label from 'SRC/embeddings.parquet', range(5) t(i)")
    plan = registry.queries()["v14_batch_search"](spark, path)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    replace("embeddings", "select vec_id + i * 10000 as vec_id, embedding, label from 'SRC/embeddings.parquet', range(2) t(i) where vec_id < 200")
    found, wanted = as_sql(spark, path, "v14_batch_search")
    assert found == wanted


def test_quality_by_label_equals_quality(spark, folder):
    path, replace = folder
    replace("embeddings", "select vec_id + i * 10000 as vec_id, embedding, case when vec_id % 7 = 0 then null else label end as label from 'SRC/embeddings.parquet', range(2) t(i) where vec_id < 200")
    found, wanted = as_sql(spark, path, "v25_quality")
    assert found == wanted


def test_quality_by_label_makes_no_pairs(spark):
    """One label for all: 1e10 relevant pairs, which would take hours one by one."""
    rows = spark.range(200_000).withColumn("label", F.lit(1))
    queries = spark.range(50_000).select(F.col("id").alias("query_id"), F.lit(1).alias("label"))
    results = queries.select("query_id", (F.col("query_id") + 1).alias("id"), F.lit(1).cast("long").alias("rank"))
    measured = metrics.quality_by_label(results, queries, rows, 5)
    assert measured.agg(F.count("*"), F.min("mrr"), F.max("recall")).first() == (50_000, 1.0, 1 / 200_000)


def test_postings_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a b, A c"), (2, ""), (3, None), (4, "Ä1 ä1"), (5, "..")], "id bigint, text string")
    found = text.postings(rows, "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["len"], r["term"], r["tf"]) for r in found.collect()} == {(1, 5, "a", 2), (1, 5, "b", 2), (1, 5, "c", 1), (4, 2, "ä1", 2)}
