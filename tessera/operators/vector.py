"""Nearest-neighbour search over array columns.

A search is a distance column, a sort and a limit, which Spark runs as one
top-k per partition and a merge; filters apply below it. Distances are computed
in double precision: ``l2`` is squared, ``cosine`` is 1 - cos (null for a zero
vector) and ``dot`` is 1 - a.b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "cosine", "dot")
#: Largest k + offset of a search.
MAX_K = 10_000
#: Ids of a lookup that are sent as a list.
IN_LIST = 500
#: Vectors up to this many dimensions are unrolled into plain arithmetic, which code generation covers.
UNROLL = 128


def _check(vector: Sequence[float], k: int, offset: int, metric: str, max_k: int) -> None:
    if not len(vector):
        raise ValueError("the query vector is empty")
    if k <= 0:
        raise ValueError("k must be positive")
    if offset < 0 or k + offset > max_k:
        raise ValueError(f"k + offset must lie between 1 and {max_k}")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")


def _total(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) // 2 * 2 :]
    return terms[0]


def distance(column: Column, vector: Sequence[float], metric: str = "l2") -> Column:
    """The distance of an array column from a constant vector; null where dimensions differ."""
    q = [float(x) for x in vector]
    if len(q) <= UNROLL:
        at = [column[i].cast("double") for i in range(len(q))]
        if metric == "l2":
            value = _total([(a - x) * (a - x) for a, x in zip(at, q, strict=True)])
        else:
            dot = _total([a * x for a, x in zip(at, q, strict=True)])
            if metric == "dot":
                value = 1 - dot
            else:
                norm = F.sqrt(_total([a * a for a in at])) * float(np.sqrt(np.dot(q, q)))
                value = F.when(norm > 0, 1 - dot / norm)
        return F.when(F.size(column) == len(q), value)
    return pair_distance(column, F.array(*[F.lit(x) for x in q]), metric)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def pair_distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """The distance of two array columns; null where dimensions differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "l2":
        value = _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    elif metric == "dot":
        value = 1 - dot
    else:
        norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
        value = F.when(norm > 0, 1 - dot / norm)
    return F.when(F.size(a) == F.size(b), value)


def search(
    table: DataFrame, vector: Sequence[float], k: int = 10, *, id_column: str = "id", vector_column: str = "vector", metric: str = "l2",
    filter: str | Column | None = None, columns: Sequence[str] | None = None, offset: int = 0, max_k: int = MAX_K,
) -> DataFrame:
    """The ``k`` rows nearest to ``vector`` after ``offset``, with ``_distance``; ties go by id, nulls last."""
    _check(vector, k, offset, metric, max_k)
    rows = table if filter is None else table.where(filter)
    found = rows.withColumn("_distance", distance(F.col(vector_column), vector, metric))
    page = found.orderBy(F.col("_distance").asc_nulls_last(), id_column).offset(offset).limit(k)
    return page.select(*(columns or [c for c in table.columns if c != vector_column]), "_distance")


def next_offset(offset: int, k: int, returned: int) -> int:
    """Where the next page starts, 0 after the last."""
    return offset + k if returned == k else 0


#: Vectors and queries that meet in one task, and those compared at once there.
CELL_ROWS, CELL_QUERIES = 1 << 16, 1 << 14
_ROWS, _QUERIES = 2048, 256
#: Rows of a table that are worth a task of their own.
_LEAST_ROWS = 4096


def _matrix(values: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of each dimension in a column of lists; missing components are NaN."""
    for chunk_start, chunk in zip(np.cumsum([0, *[len(c) for c in values.chunks]]), values.chunks, strict=False):
        sizes = chunk.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            flat = chunk.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            yield at + chunk_start, flat.astype(np.float64).reshape(len(at), dim)


def _by_dimension(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) by dimension, sorted by id."""
    ids, found = table["id"].to_numpy(), {}
    for at, data in _matrix(table["v"]):
        found.setdefault(data.shape[1], []).append((ids[at], data))
    joined = {dim: [np.concatenate(x) for x in zip(*parts, strict=True)] for dim, parts in found.items()}
    return {dim: (own[order], data[order]) for dim, (own, data) in joined.items() for order in [np.argsort(own, kind="stable")]}


def _exact(data: np.ndarray, asked: np.ndarray, metric: str) -> np.ndarray:
    """Distances of vectors row by row, the same for equal vectors wherever they stand."""
    if metric == "l2":
        return ((data - asked) ** 2).sum(1)
    dot = (data * asked).sum(1)
    if metric == "cosine":
        norm = np.sqrt((data**2).sum(1)) * np.sqrt((asked**2).sum(1))
        dot = np.divide(dot, norm, out=np.full_like(dot, np.nan), where=norm > 0)
    return 1 - dot


def _nearest(own: np.ndarray, data: np.ndarray, asked: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, distance): the ``k`` rows nearest to each query.

    A matrix product tells which rows may be among the k best, with room for its
    rounding; only these are measured exactly.
    """
    best = (np.empty(0, np.int64), np.empty(0, own.dtype), np.empty(0))
    limit = np.full(len(asked), np.inf)
    size = lambda x: np.einsum("ij,ij->i", x, x)
    asked_size = size(asked)
    for start in range(0, len(data), _ROWS):
        rows = data[start : start + _ROWS]
        rows_size = size(rows)
        with np.errstate(all="ignore"):
            rough = asked @ rows.T
            if metric == "l2":
                rough = asked_size[:, None] + rows_size[None, :] - 2 * rough
                room = (asked_size + rows_size.max()) * (data.shape[1] + 8) * 1e-15
            elif metric == "dot":
                rough = 1 - rough
                room = 1e-15 + np.sqrt(asked_size * rows_size.max()) * (data.shape[1] + 8) * 1e-15
            else:
                rough = 1 - rough / np.sqrt(asked_size[:, None] * rows_size[None, :])
                room = np.full(len(asked), (data.shape[1] + 8) * 1e-14)
            if len(rows) >= k and not np.isfinite(limit).all():
                limit = np.fmin(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + room)
            # what is not comparable stays
            q, r = np.nonzero(~(rough > (limit + room)[:, None]))
            distance = _exact(rows[r], asked[q], metric)
        known = ~np.isnan(distance)
        best = tuple(np.concatenate(x) for x in zip(best, (q[known], own[start + r[known]], distance[known]), strict=True))
        order = np.lexsort((best[1], best[2], best[0]))
        place = best[0][order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        best = tuple(x[order[rank < k]] for x in best)
        last = rank[rank < k] == k - 1
        limit[best[0][last]] = best[2][last]
    return best


def _nearest_of_cells(rows: DataFrame, asked: DataFrame, k: int, metric: str, block: int) -> DataFrame:
    """(query_id, id, _distance): the ``k`` nearest rows of each query within each cell; ``rows`` and ``asked`` are (part, id, v).

    The rows of a part meet its queries. A part is dealt to cells of about
    CELL_ROWS rows and CELL_QUERIES queries by a hash of the id, fewer rows
    where there would be fewer cells than tasks, so a task holds two small tables
    whatever the size of the input.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, asked = rows.where("v IS NOT NULL"), asked.where("v IS NOT NULL")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    largest, count = parts.agg(F.max("n"), F.count("*")).first()
    most = asked.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    across = max(1, -(-(most or 0) // CELL_QUERIES))
    down = max(-(-(largest or 0) // CELL_ROWS), min(-(-(largest or 0) // _LEAST_ROWS), -(-tasks // max(1, count * across))), 1)
    cells = max(1, count * across * down)

    def dealt(df: DataFrame, own: str, deals: int, other: str, copies: int) -> DataFrame:
        dealt_ = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(deals)).cast("int"))
        return dealt_.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("part", "a", "b", "id", "v").repartition(max(tasks, cells), "part", "a", "b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, wanted = _by_dimension(left), _by_dimension(right)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for dim in found.keys() & wanted.keys():
            (own, data), (names, vectors) = found[dim], wanted[dim]
            for at in range(0, len(names), block):
                q, i, d = _nearest(own, data, vectors[at : at + block], k, metric)
                out.append((names[at + q], i, d))
        return pa.table(dict(zip(("query_id", "id", "_distance"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    left, right = dealt(rows, "a", down, "b", across), dealt(asked, "b", across, "a", down)
    keys = ["part", "a", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id bigint, id bigint, _distance double")


def _first_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_distance", "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _asked_rows(spark, queries: DataFrame | Sequence[tuple[int, Sequence[float]]], k: int, metric: str) -> DataFrame:
    """Queries as (query_id, vector)."""
    _check([0.0], k, 0, metric, MAX_K)
    if isinstance(queries, DataFrame):
        return queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    if not len(queries):
        raise ValueError("no queries")
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in queries], "query_id bigint, vector array<double>")


def batch_search(
    table: DataFrame, queries: DataFrame | Sequence[tuple[int, Sequence[float]]], k: int = 10, *, id_column: str = "id", vector_column: str = "vector",
    metric: str = "l2", filter: str | Column | None = None, block: int = _QUERIES,
) -> DataFrame:
    """(query_id, id, _distance, rank): the ``k`` nearest rows of each query.

    ``queries`` are (query_id, vector), as a table or a list. Table and queries
    are dealt to cells, every cell of queries meets every cell of the table, by
    matrix products, and gives its own k best, so what is shuffled is k rows per
    query and cell, and the table once for each cell of queries. A query without
    a vector, or of another dimension than any row, has no rows and does not
    disturb the others; ``query_errors`` tells why.
    """
    asked = _asked_rows(table.sparkSession, queries, k, metric)
    part = F.lit(0).cast("long").alias("part")
    rows = (table if filter is None else table.where(filter)).select(part, F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return _first_of(_nearest_of_cells(rows, asked.select(part, F.col("query_id").alias("id"), F.col("vector").alias("v")), k, metric, block), k)


def query_errors(queries: DataFrame | Sequence[tuple[int, Sequence[float]]], dimension: int, spark=None) -> DataFrame:
    """(query_id, error) of the queries that a search over vectors of ``dimension`` cannot answer."""
    asked = _asked_rows(spark or queries.sparkSession, queries, 1, "l2")
    size = F.size("vector")
    error = F.when(F.col("vector").isNull() | (size == 0), "the query vector is empty").when(size != dimension, F.concat(F.lit("the query vector has "), size, F.lit(f" dimensions, the table {dimension}")))
    return asked.select("query_id", error.alias("error")).where("error IS NOT NULL")


def check_dimension(table: DataFrame, vector: Sequence[float], vector_column: str = "vector") -> None:
    """Raise if no row of the table has the dimension of ``vector``; reads one row."""
    first = table.where(F.col(vector_column).isNotNull()).select(F.size(vector_column)).first()
    if first is not None and first[0] != len(vector):
        raise ValueError(f"the query vector has {len(vector)} dimensions, the table {first[0]}")


def merge_top_k(parts: Sequence[DataFrame], k: int, id_column: str = "id", order: str = "_distance", ascending: bool = True) -> DataFrame:
    """The ``k`` best rows of several top-k results of one schema; each is cut to ``k`` before they meet."""
    if not parts:
        raise ValueError("nothing to merge")
    if k <= 0:
        raise ValueError("k must be positive")
    if any(p.dtypes != parts[0].dtypes for p in parts):
        raise ValueError("the results to merge have different schemas")
    by = F.col(order).asc_nulls_last() if ascending else F.col(order).desc_nulls_last()
    whole = None
    for p in parts:
        cut = p.orderBy(by, id_column).limit(k)
        whole = cut if whole is None else whole.unionAll(cut)
    return whole.orderBy(by, id_column).limit(k)


def search_text(table: DataFrame, text: str, k: int = 10, *, provider, vector: Sequence[float] | None = None, **options) -> DataFrame:
    """A search by a text: ``provider(texts, column)`` adds its ``vector``. A given vector is used as it is; neither is an error."""
    if vector is None:
        if not text:
            raise ValueError("a search needs a vector or a text")
        spark = table.sparkSession
        vector = provider(spark.createDataFrame([(text,)], "text string"), "text").first()["vector"]
    return search(table, vector, k, **options)


def get_by_ids(table: DataFrame, ids: Sequence[int], id_column: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the given ids; missing ids are absent and no ids give no rows. Up to IN_LIST ids are a predicate that reaches the scan, more are joined."""
    wanted = sorted({int(i) for i in ids})
    if len(wanted) <= IN_LIST:
        found = table.where(F.col(id_column).isin(wanted)) if wanted else table.where("false")
    else:
        found = table.join(table.sparkSession.createDataFrame([(i,) for i in wanted], f"{id_column} bigint"), id_column, "left_semi")
    return found.select(*(columns or table.columns))


def scan(table: DataFrame, filter: str, limit: int = 100, offset: int = 0, order_by: str = "id") -> DataFrame:
    """A page of the rows that satisfy a SQL predicate, in the order of a column."""
    if not filter:
        raise ValueError("a filter is required")
    return table.where(filter).orderBy(F.col(order_by).asc_nulls_last()).offset(offset).limit(limit)


def top_k(table: DataFrame, column: str, k: int, ascending: bool = True, tie: str | None = None) -> DataFrame:
    """Global top-k with nulls last."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return table.orderBy(order, *([tie] if tie else [])).limit(k)


def late_interaction(table: DataFrame, query_vectors: Sequence[Sequence[float]], vectors_column: str, k: int, id_column: str = "id") -> DataFrame:
    """Rows by the sum, over query vectors, of the best dot product with the row's list of vectors."""
    score = None
    for q in query_vectors:
        part = F.array_max(_dots(vectors_column, q))
        score = part if score is None else score + part
    return table.withColumn("_score", score).orderBy(F.col("_score").desc_nulls_last(), id_column).limit(k)


def late_interaction_rows(rows: DataFrame, query_vectors: Sequence[Sequence[float]], vector_column: str, k: int, id_column: str = "id") -> DataFrame:
    """The same over one vector per row: the best dot product of each query vector is an aggregate by id, so no id's vectors are gathered."""
    best = [F.max(1 - distance(F.col(vector_column), q, "dot")).alias(f"b{i}") for i, q in enumerate(query_vectors)]
    score = _total([F.col(f"b{i}") for i in range(len(query_vectors))])
    return rows.groupBy(id_column).agg(*best).select(id_column, score.alias("_score")).orderBy(F.col("_score").desc_nulls_last(), id_column).limit(k)


def _dots(column: str, q: Sequence[float]) -> Column:
    literal = F.array(*[F.lit(float(x)) for x in q])
    return F.transform(column, lambda v: 1 - pair_distance(v, literal, "dot"))


class IvfIndex:
    """An inverted file: vectors partitioned by their nearest k-means centroid.

    ``build`` fits the centroids on at most ``sample`` rows and writes every row
    into the directory of its cluster. A search reads only the ``nprobes``
    directories nearest to the query and ranks their rows by exact distance, so
    distances are comparable and all probes give exact results.
    """

    def __init__(self, spark, path: str, vector_column: str = "vector", id_column: str = "id"):
        self.spark, self.path, self.vector_column, self.id_column = spark, path, vector_column, id_column
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()
        self.centroids = np.array([r["centroid"] for r in rows], np.float64)

    @staticmethod
    def build(table: DataFrame, path: str, num_partitions: int = 32, *, vector_column: str = "vector", id_column: str = "id", sample: int = 100_000, seed: int = 7) -> IvfIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = table.sparkSession
        vectors = table.where(F.col(vector_column).isNotNull())
        # the sample is drawn by id hash, so it is the same on every run
        fitted = vectors.orderBy(F.xxhash64(id_column)).limit(sample).select(array_to_vector(F.col(vector_column).cast("array<double>")).alias("features"))
        centers = KMeans(k=num_partitions, seed=seed, maxIter=10).fit(fitted).clusterCenters()
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        matrix = np.array(centers)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            data = np.array(v.tolist(), np.float64)
            return pd.Series((((data * data).sum(1)[:, None] - 2 * data @ matrix.T) + (matrix * matrix).sum(1)[None, :]).argmin(1))

        vectors.withColumn("_cluster", nearest(vector_column)).write.partitionBy("_cluster").parquet(f"{path}/rows")
        return IvfIndex(spark, path, vector_column, id_column)

    def probes(self, vector: Sequence[float], nprobes: int) -> list[int]:
        d = ((self.centroids - np.asarray(vector, np.float64)) ** 2).sum(1)
        return [int(i) for i in np.argsort(d, kind="stable")[:nprobes]]

    def search(self, vector: Sequence[float], k: int = 10, nprobes: int = 20, **options) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("_cluster").isin(self.probes(vector, nprobes))).drop("_cluster")
        return search(rows, vector, k, id_column=self.id_column, vector_column=self.vector_column, **options)


    def batch_search(self, queries: DataFrame | Sequence[tuple[int, Sequence[float]]], k: int = 10, nprobes: int = 20, metric: str = "l2", block: int = _QUERIES) -> DataFrame:
        """(query_id, id, _distance, rank) of many queries: each meets the rows of its ``nprobes`` nearest clusters only."""
        asked = _asked_rows(self.spark, queries, k, metric)
        centroids = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centroids])
        near = F.transform(centroids, lambda c, i: F.struct(pair_distance(F.col("vector"), c, "l2").alias("d"), i.alias("part")))
        probes = F.transform(F.slice(F.array_sort(near), 1, nprobes), lambda s: s["part"].cast("long"))
        spread = asked.select(F.explode(probes).alias("part"), F.col("query_id").alias("id"), F.col("vector").alias("v"))
        rows = self.spark.read.parquet(f"{self.path}/rows").select(F.col("_cluster").cast("long").alias("part"), F.col(self.id_column).cast("long").alias("id"), F.col(self.vector_column).alias("v"))
        return _first_of(_nearest_of_cells(rows, spread, k, metric, block), k)


#: Index types by name; approximate structures other than inverted files are backed by one with exact distances.
INDEX_TYPES = frozenset(["", "IVF_FLAT", "IVF_PQ", "IVF_HNSW_SQ", "IVF_HNSW_PQ"])


class ScalarIndex:
    """A copy of a table in a layout that lets Spark skip what a predicate on one column excludes.

    ``BTREE`` sorts by the column, so the statistics of files and row groups
    select a range. ``BITMAP`` puts each value into a directory of its own, for
    columns of few values. ``LABEL_LIST`` has a row for each label of an array
    column, sorted by label, with the label in ``_label``.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def build(table: DataFrame, path: str, index_type: str, column: str, partitions: int | None = None) -> ScalarIndex:
        count = [partitions] if partitions else []
        if index_type == "BITMAP":
            # values stay where they are in the rows as well: a directory name has no type
            table.withColumn("_value", F.col(column)).repartition(*count, "_value", F.pmod(F.xxhash64(*table.columns), F.lit(8))).write.partitionBy("_value").parquet(path)
        else:
            by, rows = column, table
            if index_type == "LABEL_LIST":
                by, rows = "_label", table.withColumn("_label", F.explode(column))
            rows.repartitionByRange(*count, by).sortWithinPartitions(by).write.parquet(path)
        return ScalarIndex(table.sparkSession, path)

    def read(self, filter: str) -> DataFrame:
        """The rows that satisfy a predicate."""
        rows = self.spark.read.parquet(self.path)
        return rows.where(filter).drop("_value")


SCALAR_TYPES = frozenset(["BTREE", "BITMAP", "LABEL_LIST"])
TEXT_TYPES = frozenset(["FTS", "INVERTED"])


def create_index(table: DataFrame, path: str, index_type: str = "IVF_FLAT", **options):
    """An index of a named type: inverted files for vectors, layouts for scalar columns, postings for text."""
    kind = index_type.upper()
    if kind in SCALAR_TYPES:
        return ScalarIndex.build(table, path, kind, **options)
    if kind in TEXT_TYPES:
        from tessera.operators.text import TextIndex

        return TextIndex.build(table, path, **options)
    if kind not in INDEX_TYPES:
        raise ValueError(f"unknown index type {index_type!r}")
    return IvfIndex.build(table, path, **options)


def mock_embedding(text: str, dimension: int) -> list[float]:
    """A deterministic stand-in for a text embedding, for tests: numbers in [-1, 1) drawn with the text's digest as seed."""
    seed = np.frombuffer(hashlib.blake2b(text.encode(), digest_size=16).digest(), np.uint32)
    return (np.random.Generator(np.random.PCG64(seed.tolist())).random(dimension) * 2 - 1).tolist()


def embed(texts: DataFrame, column: str, dimension: int = 64, output: str = "vector") -> DataFrame:
    """Mock embeddings of a text column."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else mock_embedding(t, dimension))

    return texts.withColumn(output, run(column))
