"""Scalar functions that Spark lacks, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_EUCLID = (
    "aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), "
    "(s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)"
)


def register(spark: SparkSession) -> None:
    """Make ``tessera_gcd`` and ``tessera_lcm`` known to SQL. 93 steps of Euclid's algorithm reach any pair of longs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tessera_gcd(a BIGINT, b BIGINT) RETURNS BIGINT RETURN {_EUCLID}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tessera_lcm(a BIGINT, b BIGINT) RETURNS BIGINT RETURN if(a = 0 OR b = 0, 0, abs(a) DIV ({_EUCLID}) * abs(b))")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a) / gcd(a, b)).cast("long") * F.abs(b))


def trunc(x: Column, places: int = 0) -> Column:
    """A number cut towards zero at a decimal place."""
    scale = 10**places
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def iszero(x: Column) -> Column:
    return x == 0


def date_bin(stride_seconds: int, ts: Column, origin: str = "1970-01-01") -> Column:
    """The start of the stride that a timestamp falls in, counted from ``origin``."""
    start = F.unix_timestamp(F.lit(origin).cast("timestamp"))
    seconds = F.unix_timestamp(ts.cast("timestamp")) - start
    return F.timestamp_seconds(start + F.floor(seconds / stride_seconds) * stride_seconds)


def array_has_all(outer: Column, inner: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def array_slice(x: Column, first: int, last: int) -> Column:
    """Elements ``first`` to ``last`` (from 1, both included)."""
    return F.slice(x, first, last - first + 1)


def split_literal(x: Column, delimiter: str) -> Column:
    """``split`` on a literal string instead of a regular expression."""
    return F.split(x, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def epoch_nanos(ts: Column) -> Column:
    """Nanoseconds since 1970, of microsecond precision."""
    return F.unix_micros(ts.cast("timestamp")) * 1000
