"""Connected components of an edge table, as joins and grouped minima.

Alternates the large-star and small-star steps of Kiveris et al., "Connected
Components in MapReduce and Beyond" (SoCC 2014): edges are rewired towards the
smallest neighbour until every component is a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rewired = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewired.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (two columns of longs).

    ``component`` is the smallest id of the vertex's component. Self-loops are
    dropped; rows with a null end are no edges; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    state = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    state = materialize(state, "cc-edges")
    seen = None
    while True:
        state = materialize(_small_star(_large_star(state)), "cc-round")
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    members = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionAll(roots)
