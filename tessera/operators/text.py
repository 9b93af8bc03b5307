"""Full-text search by BM25 with corpus-wide statistics, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def query_terms(query: str) -> list[str]:
    import regex

    return sorted({t for t in regex.split(TOKEN_BREAK, query.lower()) if t})


def bm25(table: DataFrame, text_column: str, query: str, id_column: str = "id", k1: float = K1, b: float = B) -> DataFrame:
    """(id, _score) of the rows that hold a query term.

    Term counts are taken per row with array functions, so the corpus is not
    exploded; statistics are one small aggregate.
    """
    terms = query_terms(query)
    if not terms:
        raise ValueError("the query has no terms")
    counted = table.select(F.col(id_column), tokens(F.col(text_column)).alias("ts")).select(
        id_column, F.size("ts").alias("len"), *[F.size(F.filter("ts", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    )
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = None
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        part = F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))).otherwise(0.0)
        score = part if score is None else score + part
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return counted.where(hit).crossJoin(F.broadcast(stats)).select(id_column, score.alias("_score"))


def _equals(term: str):
    return lambda x: x == term


def text_search(table: DataFrame, query: str, k: int = 10, *, text_column: str = "text", id_column: str = "id", filter: str | Column | None = None, offset: int = 0) -> DataFrame:
    """The ``k`` best rows by BM25, (id, _score), ties by id; the filter applies before statistics and ranking."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = table if filter is None else table.where(filter)
    return bm25(rows, text_column, query, id_column).orderBy(F.col("_score").desc_nulls_last(), id_column).offset(offset).limit(k)


sparse_search = text_search


class TextIndex:
    """Postings on disk, in directories by a hash of the term and sorted by term, with the corpus statistics.

    A search reads the directories of its terms only, and of these the row
    groups that hold them. Statistics are those of the whole corpus.
    """

    BUCKETS = 64

    def __init__(self, spark, path: str, id_column: str):
        self.spark, self.path, self.id_column = spark, path, id_column
        self.stats = spark.read.parquet(f"{path}/stats").first()

    @staticmethod
    def bucket(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(TextIndex.BUCKETS)).cast("int")

    @staticmethod
    def build(table: DataFrame, path: str, *, text_column: str = "text", id_column: str = "id") -> TextIndex:
        spark = table.sparkSession
        sizes = table.select(F.size(tokens(F.coalesce(F.col(text_column), F.lit("")))).alias("len"))
        sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).write.parquet(f"{path}/stats")
        found = postings(table, text_column, id_column).withColumn("_bucket", TextIndex.bucket(F.col("term")))
        # a frequent term's postings are dealt over several tasks
        dealt = found.repartition("_bucket", F.pmod(F.xxhash64(id_column), F.lit(4)))
        dealt.sortWithinPartitions("_bucket", "term").write.partitionBy("_bucket").parquet(f"{path}/postings")
        return TextIndex(spark, path, id_column)

    def search(self, query: str, k: int = 10, *, offset: int = 0, among: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """The ``k`` best rows by BM25, (id, _score), ties by id; ``among`` restricts the ids that are ranked."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("the query has no terms")
        if k <= 0:
            raise ValueError("k must be positive")
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = [r[0] for r in asked.select(self.bucket(F.col("term"))).distinct().collect()]
        found = self.spark.read.parquet(f"{self.path}/postings").where(F.col("_bucket").isin(buckets) & F.col("term").isin(terms)).drop("_bucket")
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        n, avgdl = self.stats["n"], self.stats["avgdl"]
        idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / avgdl))
        rows = found if among is None else found.join(among.select(self.id_column), self.id_column, "left_semi")
        # one row for each term of the query
        scored = rows.join(F.broadcast(df), "term").groupBy(self.id_column).agg(F.sum(part).alias("_score"))
        return scored.orderBy(F.col("_score").desc_nulls_last(), self.id_column).offset(offset).limit(k)


def postings(table: DataFrame, text_column: str, id_column: str = "id") -> DataFrame:
    """(id, len, term, tf): an inverted index to write partitioned by a hash of the term.

    A row's terms are sorted and their runs counted, so nothing is shuffled for it.
    """
    rows = table.select(F.col(id_column), F.sort_array(tokens(F.col(text_column))).alias("ts")).where(F.size("ts") > 0)
    # the arrays around columns keep their expressions from being evaluated again in the lambdas
    rows = rows.select(id_column, F.explode(F.array("ts")).alias("ts"))
    places = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i) != F.get("ts", i - 1)))
    runs = rows.select(id_column, "ts", F.explode(F.array(places)).alias("starts"))
    counted = F.transform("starts", lambda i, j: F.struct(F.get("ts", i).alias("term"), (F.coalesce(F.get("starts", j + 1), F.size("ts")) - i).cast("long").alias("tf")))
    return runs.select(id_column, F.size("ts").alias("len"), F.inline(counted))
