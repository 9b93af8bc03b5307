"""Queries of the retrieval operators, sources and versioned tables, with their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions, sources, streaming
from tessera.operators import hybrid, metrics, text, vector
from tessera.operators.tables import VersionedTable
from tessera.session import load, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def scratch(spark: SparkSession) -> str:
    """A new folder name where queries may write, in the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _ann(metric: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = load(spark, sf_dir, "embeddings")
        found = vector.search(table, _query_vector(spark, sf_dir), 10, id_column="vec_id", vector_column="embedding", metric=metric, columns=["vec_id", "label"], **options)
        return found.select("vec_id", "label", (F.round("_distance", 6) + 0.0).alias("distance"))

    return run


_DISTANCE = {
    "l2": "list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.embedding[i]::double) * (e.embedding[i]::double - q.embedding[i]::double)))",
    "dot": "1 - list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * q.embedding[i]::double))",
    "cosine": "1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[])",
}


def _ann_sql(metric: str, where: str = "true", limit: str = "limit 10") -> str:
    return f"""select e.vec_id, e.label, round({_DISTANCE[metric]}, 6) + 0.0 as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q
               where {where} order by {_DISTANCE[metric]}, e.vec_id {limit}"""


def v7_ivf_all_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = vector.create_index(load(spark, sf_dir, "embeddings"), scratch(spark), "IVF_FLAT", num_partitions=16, vector_column="embedding", id_column="vec_id")
    found = index.search(_query_vector(spark, sf_dir), 10, nprobes=16, columns=["vec_id", "label"])
    return found.select("vec_id", "label", (F.round("_distance", 6) + 0.0).alias("distance"))


def v7_ivf_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every twentieth vector by the index; tests hold its recall against ``v14_batch_search``."""
    table = load(spark, sf_dir, "embeddings")
    index = vector.create_index(table, scratch(spark), "IVF_PQ", num_partitions=16, vector_column="embedding", id_column="vec_id")
    found = index.batch_search(_asked(table), 5, nprobes=8)
    return found.select("query_id", "id", "rank", (F.round("_distance", 6) + 0.0).alias("distance"))


def _asked(table: DataFrame) -> DataFrame:
    """The stated queries: every row whose id is divisible by 20."""
    return table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def v9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.text_search(_text(spark, sf_dir), "the ention", 20, id_column="doc_id").select("doc_id", F.round("_score", 6).alias("score"))


def v9_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sparse_search(_text(spark, sf_dir), "the ention", 20, id_column="doc_id", filter="lang = 'en'").select("doc_id", F.round("_score", 6).alias("score"))


def _bm25_sql(where: str = "true", limit: int = 20) -> str:
    return rf"""
with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ts from documents where {where}),
c as (select doc_id, len(ts) as len, len(list_filter(ts, lambda x: x = 'the')) as tf1, len(list_filter(ts, lambda x: x = 'ention')) as tf0 from t),
s as (select count(*) as n, avg(len) as avgdl, sum((tf0 > 0)::int) as df0, sum((tf1 > 0)::int) as df1 from c),
r as (select doc_id, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / avgdl))
                   + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / avgdl)) as score from c, s where tf0 + tf1 > 0)
select doc_id, round(score, 6) as score from r order by r.score desc, doc_id limit {limit}"""


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return _text(spark, sf_dir).join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "text", "embedding")


def v11_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hybrid.hybrid_search(_both(spark, sf_dir), _query_vector(spark, sf_dir), "the ention", 10, id_column="doc_id", vector_column="embedding")
    return found.select("doc_id", F.round("_relevance_score", 9).alias("relevance"))


_HYBRID_SQL = f"""
with b as (select doc_id, text, embedding from documents join embeddings on doc_id = vec_id),
a as (select e.doc_id, row_number() over (order by {_DISTANCE['l2']}, e.doc_id) as rank from b e, (select embedding from embeddings where vec_id = 0) q),
f as (select doc_id, row_number() over (order by sc desc, doc_id) as rank from (
    with t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ts from b),
    c as (select doc_id, len(ts) as len, len(list_filter(ts, lambda x: x = 'the')) as tf1, len(list_filter(ts, lambda x: x = 'ention')) as tf0 from t),
    s as (select count(*) as n, avg(len) as avgdl, sum((tf0 > 0)::int) as df0, sum((tf1 > 0)::int) as df1 from c)
    select doc_id, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / avgdl))
                 + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / avgdl)) as sc from c, s where tf0 + tf1 > 0))
select doc_id, round(sum(1.0 / (60 + rank)), 9) as relevance from (select * from a where rank <= 20 union all select * from f where rank <= 20)
group by doc_id order by sum(1.0 / (60 + rank)) desc, doc_id limit 10"""


def v12_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance fused with customers by nation, each the first 40; many nations and some ranks tie."""
    rows = load(spark, sf_dir, "customer")
    ann = rows.select(F.col("c_custkey").alias("id"), F.abs("c_acctbal").alias("_distance")).orderBy("_distance", "id").limit(40)
    fts = rows.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("_score")).orderBy(F.desc("_score"), "id").limit(40)
    return hybrid.reciprocal_rank_fusion(ann, fts, 60, 50).select("id", F.round("_relevance_score", 9).alias("relevance"))


def v9_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = text.TextIndex.build(_text(spark, sf_dir), scratch(spark), id_column="doc_id")
    return index.search("the ention", 20).select("doc_id", F.round("_score", 6).alias("score"))


def v13_merge_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of two halves of the table, merged."""
    table, asked = load(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    halves = [table.where(F.col("label") % 2 == x) for x in (0, 1)]
    found = [vector.search(h, asked, 10, id_column="vec_id", vector_column="embedding", columns=["vec_id", "label"]) for h in halves]
    return vector.merge_top_k(found, 10, "vec_id").select("vec_id", "label", (F.round("_distance", 6) + 0.0).alias("distance"))


def v15_text_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nearest to a text under a provider that counts vowels."""

    def provider(texts: DataFrame, column: str) -> DataFrame:
        counts = [F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(v)).cast("double") for v in "aeiou"]
        return texts.withColumn("vector", F.array(*counts))

    rows = provider(_text(spark, sf_dir), "text").select(F.col("doc_id").alias("id"), "vector")
    return vector.search_text(rows, "the quiet audio of one tune", 10, provider=provider).select("id", F.round("_distance", 6).alias("distance"))


_TEXT_VECTOR_SQL = """
with q as (select list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: len('the quiet audio of one tune') - len(replace('the quiet audio of one tune', v, ''))) as q),
d as (select doc_id as id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: len(coalesce(text, '')) - len(replace(coalesce(text, ''), v, ''))) as v from documents)
select id, round(list_sum(list_transform(range(1, 6), lambda i: (v[i] - q[i])::double * (v[i] - q[i]))), 6) as distance from d, q
order by list_sum(list_transform(range(1, 6), lambda i: (v[i] - q[i])::double * (v[i] - q[i]))), id limit 10"""


def w19_scalar_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a price band and status through a sorted and a bitmap-like layout, unioned."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    by_price = vector.create_index(orders, scratch(spark), "BTREE", column="o_totalprice").read("o_totalprice between 1000 and 20000")
    by_status = vector.create_index(orders, scratch(spark), "BITMAP", column="o_orderstatus").read("o_orderstatus = 'F'")
    return by_price.select("o_orderkey", "o_totalprice", "o_orderstatus").unionByName(by_status.select("o_orderkey", "o_totalprice", "o_orderstatus"))


def w5_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view is created, read and dropped."""
    load(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    spark.sql("create or replace temporary view revenue as select l_suppkey, sum(l_quantity) as qty from lineitem group by l_suppkey")
    found = spark.sql("select l_suppkey, cast(qty as double) as qty from revenue where qty = (select max(qty) from revenue)")
    spark.sql("drop view revenue")
    return found


def p14_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    plan = spark.sql("explain formatted select l_orderkey from lineitem where l_quantity > 45")
    return plan.select(F.col("plan").contains("GreaterThan(l_quantity").alias("pushed"), F.col("plan").contains("ReadSchema: struct<l_orderkey").alias("pruned"))


def p15_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = "tessera.example.setting"
    spark.sql(f"set {key} = 17")
    shown = spark.sql(f"set {key}").select("key", "value")
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return shown.unionAll(spark.sql("show columns in nation").select(F.lit("column").alias("key"), F.col("col_name").alias("value")))


def p17_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").cache()
    n = nation.count()
    found = spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(nation.is_cached).alias("cached"))
    nation.unpersist()
    return found


def s10_information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("customer", "nation"):
        load(spark, sf_dir, t).createOrReplaceTempView(t)
    return sources.information_schema(spark, ["customer", "nation"]).select("table_name", "column_name", "ordinal_position")


def w16_drop_and_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped table is gone; vacuum removes what a failed write left and nothing else."""
    table = _table(spark, sf_dir)
    load(spark, sf_dir, "nation").write.parquet(f"{table.path}/data/left-over")
    gone, rows = table.vacuum(0), table.read().count()
    table.drop()
    left = VersionedTable.list(spark, table.path.rsplit("/", 1)[0])
    return spark.range(1).select(F.lit(len(gone)).cast("long").alias("gone"), F.lit(rows).cast("long").alias("rows"), F.lit(table.path.rsplit("/", 1)[1] in left).alias("there"))


def w23_split_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sources.split_shards(load(spark, sf_dir, "part").select("p_partkey", "p_name"), path, 4, ["p_partkey"])
    return spark.read.parquet(path)


def f_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions of this package that no SQL name stands for."""
    part = load(spark, sf_dir, "part")
    return part.select(
        "p_partkey", functions.trunc(F.col("p_retailprice"), 1).alias("tr"), functions.iszero(F.col("p_size") % 7).alias("z"),
        functions.array_has_all(F.array(F.lit(1), "p_size"), F.array(F.lit(1))).alias("has"), functions.array_slice(F.array(F.lit(1), "p_size", F.lit(3)), 2, 3).alias("sl"),
        functions.split_literal(F.lit("a.b|c"), ".")[1].alias("sp"), functions.epoch_nanos(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("ns"),
        F.unix_timestamp(functions.date_bin(900, F.lit("2024-01-02 03:04:05").cast("timestamp"))).alias("bin"),
        functions.gcd(F.col("p_partkey"), F.col("p_size")).alias("g"), functions.lcm(F.col("p_partkey"), F.col("p_size")).alias("l"),
    )


def v14_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "embeddings")
    return vector.batch_search(table, _asked(table), 5, id_column="vec_id", vector_column="embedding").select("query_id", "id", "rank", (F.round("_distance", 6) + 0.0).alias("distance"))


_BATCH_SQL = f"""
select * from (select q.vec_id as query_id, e.vec_id as id, row_number() over (partition by q.vec_id order by {_DISTANCE['l2']}, e.vec_id) as rank, round({_DISTANCE['l2']}, 6) + 0.0 as distance
               from embeddings e, (select vec_id, embedding from embeddings where vec_id % 20 = 0) q) where rank <= 5"""


def v16_mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.embed(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", 16)
    return found.select("doc_id", F.size("vector").alias("dimension"), F.round(F.array_max("vector"), 6).alias("largest"))


def v21_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.scan(load(spark, sf_dir, "embeddings").select("vec_id", "label"), "label = 3 AND vec_id > 20", 15, 5, "vec_id")


def v24_late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbouring vectors make a row; rows of many vectors are never gathered."""
    rows = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("id"), "embedding")
    asked = [_query_vector(spark, sf_dir, i) for i in (0, 1)]
    return vector.late_interaction_rows(rows, asked, "embedding", 10).select("id", F.round("_score", 6).alias("score"))


_LATE_SQL = """
with s as (select e.vec_id // 4 as id, q.vec_id as q, max(list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::double * q.embedding[i]::double))) as best
           from embeddings e, (select * from embeddings where vec_id in (0, 1)) q group by all)
select id, round(sum(best), 6) as score from s group by id order by sum(best) desc, id limit 10"""


def v25_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search quality where an embedding is relevant if it has the query's label."""
    table = load(spark, sf_dir, "embeddings")
    results = v14_batch(spark, sf_dir)
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    found = metrics.quality_by_label(results, queries, table.select(F.col("vec_id").alias("id"), "label"), 5)
    return found.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "ndcg", "mrr")])


_QUALITY_SQL = f"""
with r as ({_BATCH_SQL}), rel as (select q.vec_id as query_id, e.vec_id as id from embeddings e join (select * from embeddings where vec_id % 20 = 0) q on e.label = q.label),
h as (select r.query_id, count(*) as h, sum(1 / log2(rank + 1)) as dcg, min(rank) as first from r join rel using (query_id, id) group by r.query_id),
n as (select query_id, count(*) as n from rel group by query_id)
select query_id, round(coalesce(h / n, 0), 9) as recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 9) as ndcg,
       round(coalesce(1 / first, 0), 9) as mrr from n left join h using (query_id)"""


def s15_get_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.get_by_ids(load(spark, sf_dir, "embeddings"), [3, 5, 8, 10**9], "vec_id", ["vec_id", "label"])


def s1_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.from_path(spark, f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")


def _through(kind: str) -> Query:
    """Write customers in a format and read them back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, df = scratch(spark), load(spark, sf_dir, "customer")
        if kind == "csv":
            sources.write_csv(df, path)
            return sources.read_csv(spark, path, df.schema)
        if kind == "tbl":
            df.select("*", F.lit("x").alias("end")).write.option("sep", "|").csv(path)
            return sources.read_tbl(spark, path, df.schema)
        if kind == "json":
            sources.write_json(df, path)
            return sources.read_json(spark, path, df.schema)
        sources.write_parquet(df, path, column_options={"c_custkey": {"parquet.bloom.filter.enabled": "true"}})
        sources.external_table(spark, "external_customer", path)
        return spark.sql("select * from external_customer")

    return run


_CUSTOMER = "select * from customer"


def w4_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nation = scratch(spark), load(spark, sf_dir, "nation")
    return sources.insert_into(nation, path, nation.schema)


def _table(spark: SparkSession, sf_dir: str) -> VersionedTable:
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return VersionedTable.create(rows, scratch(spark))


def w8_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    table, more = VersionedTable.create(rows.where("c_nationkey < 12"), scratch(spark)), rows.where("c_nationkey >= 12")
    first = table.append(more, request_id="r1")
    if table.append(more, request_id="r1") != first:
        raise AssertionError("a request was applied twice")
    return table.read(min_version=2)


def w10_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    table.delete("nullif(c_nationkey, 3) > 12")
    return table.read()


def w11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed customers replace their rows, and mirrored ones are added.

    Rows are told apart by a number of their own: customer keys may repeat, be 0 or be mirrored already.
    """
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    table = VersionedTable.create(rows.withColumn("row", F.monotonically_increasing_id()), scratch(spark))
    renamed = table.read().withColumn("c_name", F.concat(F.lit("new-"), "c_name"))
    changed = renamed.where("c_mktsegment = 'BUILDING'")
    added = renamed.where("c_nationkey = 5").withColumns({"c_custkey": -F.col("c_custkey"), "row": -1 - F.col("row")})
    table.upsert(changed.unionByName(added), ["row"])
    return table.read().select("c_custkey", "c_name", "c_nationkey")


def w12_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    table.alter(add=[("note", "string")], drop=["c_nationkey"], rename={"c_name": "name"}, expected_schema_version=1)
    table.append(spark.createDataFrame([(-1, "extra", "hello")], "c_custkey bigint, name string, note string"))
    return table.read(min_schema_version=2)


def w17_tag_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    table.tag("before")
    table.delete("c_nationkey >= 10")
    table.tag("after")
    at_tag = table.read("after").agg(F.count("*").alias("n"))
    table.restore(tag="before")
    table.compact()
    return table.read().agg(F.count("*").alias("n")).unionAll(at_tag).unionAll(spark.range(1).select(F.lit(table.versions()[-1]).cast("long")))


def w21_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), table.count("c_nationkey = 3")) for f in table.schema()], "column string, kind string, n bigint")


def w_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a stream that has read all events, as a table."""
    path = scratch(spark)
    load(spark, sf_dir, "events").write.parquet(path)
    counts = streaming.windowed_counts(streaming.read_events(spark, path), "6 hours")
    out, state = scratch(spark), scratch(spark)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream = counts.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    stream.awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def w_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.sessions(load(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


QUERIES: dict[str, Query] = {
    "v1_ann_l2": _ann("l2"), "v4_ann_cosine": _ann("cosine"), "v5_ann_dot": _ann("dot"), "v6_ann_filtered": _ann("l2", filter="label IN (1, 2, 3)"),
    "v17_ann_page": _ann("l2", offset=10), "v7_ivf_all_probes": v7_ivf_all_probes, "v7_ivf_probed": v7_ivf_probed, "v9_bm25": v9_bm25, "v10_sparse_filtered": v9_bm25_filtered,
    "v11_hybrid": v11_hybrid, "v12_rrf": v12_rrf, "v14_batch_search": v14_batch, "v16_mock_embedding": v16_mock_embedding, "v21_expression_scan": v21_scan,
    "v24_late_interaction": v24_late_interaction, "v25_quality": v25_quality, "s15_get_by_ids": s15_get_by_ids, "s1_parquet_path": s1_parquet,
    "s2_csv": _through("csv"), "s3_tbl": _through("tbl"), "s4_json": _through("json"), "s8_external_table": _through("parquet"), "w4_insert_count": w4_insert,
    "w8_append": w8_append, "w10_delete": w10_delete, "w11_upsert": w11_upsert, "w12_alter": w12_alter, "w17_tag_restore": w17_tag_restore, "w21_metadata": w21_metadata,
    "w_streaming_windows": w_streaming, "w_sessions": w_sessions, "v9_indexed": v9_indexed, "v13_merge_top_k": v13_merge_top_k, "v15_text_to_vector": v15_text_to_vector,
    "w19_scalar_index": w19_scalar_index, "w5_views": w5_views, "p14_explain": p14_explain, "p15_settings": p15_settings, "p17_cache": p17_cache,
    "s10_information_schema": s10_information_schema, "w16_drop_and_vacuum": w16_drop_and_vacuum, "w23_split_shards": w23_split_shards, "f_helpers": f_helpers,
}

ORACLE_SQL: dict[str, str] = {
    "v1_ann_l2": _ann_sql("l2"), "v4_ann_cosine": _ann_sql("cosine"), "v5_ann_dot": _ann_sql("dot"), "v6_ann_filtered": _ann_sql("l2", "e.label in (1, 2, 3)"),
    "v17_ann_page": _ann_sql("l2", limit="limit 10 offset 10"), "v7_ivf_all_probes": _ann_sql("l2"), "v9_bm25": _bm25_sql(), "v10_sparse_filtered": _bm25_sql("lang = 'en'"),
    "v11_hybrid": _HYBRID_SQL,
    "v12_rrf": """with a as (select c_custkey as id, row_number() over (order by abs(c_acctbal), c_custkey) as rank from customer), f as (select c_custkey as id, row_number() over (order by c_nationkey desc, c_custkey) as rank from customer)
        select id, round(sum(1.0::double / (60 + rank)), 9) as relevance from (select * from a where rank <= 40 union all select * from f where rank <= 40) group by id order by sum(1.0::double / (60 + rank)) desc, id limit 50""",
    "v9_indexed": _bm25_sql(), "v13_merge_top_k": _ann_sql("l2"), "v15_text_to_vector": _TEXT_VECTOR_SQL,
    "w19_scalar_index": "select o_orderkey, o_totalprice, o_orderstatus from orders where o_totalprice between 1000 and 20000 union all select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus = 'F'",
    "w5_views": "with r as (select l_suppkey, sum(l_quantity)::double as qty from lineitem group by l_suppkey) select l_suppkey, qty from r where qty = (select max(qty) from r)",
    "p14_explain": "select true as pushed, true as pruned",
    "p15_settings": "select * from (values ('tessera.example.setting', '17'), ('column', 'n_nationkey'), ('column', 'n_name'), ('column', 'n_regionkey')) as t(\"key\", \"value\")",
    "p17_cache": "select count(*) as n, true as cached from nation",
    "s10_information_schema": "select table_name, column_name, ordinal_position::bigint as ordinal_position from information_schema.columns where table_name in ('customer', 'nation')",
    "w16_drop_and_vacuum": "select 1::bigint as gone, count(*) as rows, false as there from customer",
    "w23_split_shards": "select p_partkey, p_name from part",
    "f_helpers": "select p_partkey, trunc(p_retailprice * 10) / 10 as tr, p_size % 7 = 0 as z, true as has, [p_size, 3] as sl, 'b|c' as sp, 1704164645000000000 as ns, 1704164400::bigint as bin, cast(gcd(p_partkey, p_size) as bigint) as g, cast(lcm(p_partkey, p_size) as bigint) as l from part",
    "v14_batch_search": _BATCH_SQL, "v21_expression_scan": "select vec_id, label from embeddings where label = 3 and vec_id > 20 order by vec_id limit 15 offset 5",
    "v24_late_interaction": _LATE_SQL, "v25_quality": _QUALITY_SQL, "s15_get_by_ids": "select vec_id, label from embeddings where vec_id in (3, 5, 8)",
    "s1_parquet_path": "select n_nationkey, n_name from nation", "s2_csv": _CUSTOMER, "s3_tbl": _CUSTOMER, "s4_json": _CUSTOMER, "s8_external_table": _CUSTOMER,
    "w4_insert_count": "select count(*) as count from nation",
    "w8_append": "select c_custkey, c_name, c_nationkey from customer",
    "w10_delete": "select c_custkey, c_name, c_nationkey from customer where not coalesce(nullif(c_nationkey, 3) > 12, false)",
    "w11_upsert": "select c_custkey, case when c_mktsegment = 'BUILDING' then 'new-' || c_name else c_name end as c_name, c_nationkey from customer union all select -c_custkey, 'new-' || c_name, c_nationkey from customer where c_nationkey = 5",
    "w12_alter": "select c_custkey, c_name as name, null::varchar as note from customer union all select -1, 'extra', 'hello'",
    "w17_tag_restore": "select count(*) as n from customer union all select count(*) from customer where c_nationkey < 10 union all select 4",
    "w21_metadata": "select t.*, (select count(*) from customer where c_nationkey = 3) as n from (values ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int')) as t(\"column\", kind)",
    "w_streaming_windows": "select time_bucket(interval '6 hours', ts) as start, event_type, count(*) as n from events group by all",
    "w_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events) select user_id, sum(new)::bigint as sessions, count(*) as n from g group by user_id",
}
