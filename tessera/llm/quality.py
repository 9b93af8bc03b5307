"""Quality rules with thresholds that adapt to language and source.

Each document is measured, the measurements of a (language, source) group are
gathered into a mergeable quantile sketch, and a document is rejected when a
measurement lies far outside what the middle four fifths of its own group show,
above for all rules and also below for the length of words. Groups too small to
judge use the merged sketch of their language, and failing that of the corpus.

The sketch is a histogram over buckets of bounded relative width (values below
16 exactly, then 16 buckets for each doubling). Merging is adding counts, so
Spark combines it on the map side, a hot source costs no more than a small one,
and the result does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow_text import ODD, as_text, mix, slices, split_pieces, words_of
from tessera.llm.storage import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
VERDICT = ("base_failed", "rules_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """Reject above ``q90 + reach * max(q90 - q50, least)`` of the group, and if ``low`` below ``q10 - reach * max(q50 - q10, least)``; values are whole numbers."""

    name: str
    value: str
    least: int
    reach: int = 6
    low: bool = False


#: Least spreads keep groups in which nine tenths show no variation from rejecting ordinary documents.
RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(n_words, 1)", 20),
    Rule("word_length", "1000 * word_chars div greatest(n_words, 1)", 250, reach=5, low=True),
    Rule("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 70),
    Rule("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", 40),
)
LIMITS = [f"limit_{r.name}" for r in RULES] + [f"floor_{r.name}" for r in RULES if r.low]
#: Documents that a group's own sketch needs.
LEAST_GROUP = 100


def _repeat_words(words, documents: int) -> np.ndarray:
    """Words of each document inside a window of 8 words that the document holds twice or more."""
    n, starts = len(words.ids), words.starts
    windows = n - WINDOW + 1
    if windows < 2:
        return np.zeros(documents, np.int64)
    docs = words.documents()
    h = words.hashes()[words.ids]
    acc = np.zeros(windows, np.uint64)
    for j in range(WINDOW):
        acc = acc * ODD + h[j : j + windows]
    acc = mix(mix(acc) + docs[:windows].astype(np.uint64) * ODD)
    inside = np.flatnonzero(docs[:windows] == docs[WINDOW - 1 :])
    value = acc[inside]
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(inside), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = inside[twice]
    cover = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + WINDOW, minlength=n + 1)[: n + 1]
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:n] > 0)))
    return covered[starts[1:]] - covered[starts[:-1]]


def _dup_lines(text: pa.Array, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word in each document, and those equal to an earlier line of it."""
    parts = pc.split_pattern(text, "\n")
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    docs = np.repeat(np.arange(documents), np.diff(offsets))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False).astype(bool)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[worded]
    docs = docs[worded]
    lines = np.bincount(docs, minlength=documents)
    key = docs * (ids.max(initial=0) + 1) + ids
    first = np.unique(key, return_index=True)[1]
    return lines, lines - np.bincount(docs[first], minlength=documents)


def _measure_batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    text = as_text(batch.column("text"))
    n = len(text)
    words = words_of(text)
    length = pc.utf8_length(words.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.concatenate(([0], np.cumsum(length[words.ids]))) if len(words.ids) else np.zeros(1, np.int64)
    lines, dup = _dup_lines(text, n)
    return {
        "n_words": words.counts,
        "word_chars": chars[words.starts[1:]] - chars[words.starts[:-1]],
        "n_symbols": pc.count_substring_regex(text, SYMBOLS).to_numpy(zero_copy_only=False),
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": _repeat_words(words, n),
    }


def measure(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of MEASURES (longs); columns of those names are replaced.

    A null text counts as empty. Every row is measured by itself, so repeated
    rows and extra columns do no harm.
    """
    kept = [f for f in docs.schema.fields if f.name not in MEASURES and (keep_text or f.name != "text")]
    schema = T.StructType(kept + [T.StructField(m, T.LongType()) for m in MEASURES])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            measured = _measure_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names] + [pa.array(measured[m].astype(np.int64)) for m in MEASURES], names=[*names, *MEASURES]
            )

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """The sketch's bucket of a non-negative whole number."""
    bits = F.length(F.bin(value)) - 1
    return F.when(value < 16, value).otherwise(16 * (bits - 3).cast("long") + F.call_function("shiftright", value, (bits - 4).cast("int")) - 16)


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    doublings = F.floor(b / 16).cast("int") - 1
    return F.when(b < 16, b).otherwise(F.call_function("shiftleft", F.pmod(b, F.lit(16)) + 16, doublings))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): one sketch for each group and rule."""
    values = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).alias("value")) for r in RULES])
    rows = measured.select("lang", "source", F.inline(values))
    return rows.groupBy("lang", "source", "rule", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def _merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def _fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, docs, the limits of each rule) of sketches."""
    window = Window.partitionBy(*keys, "rule").orderBy("bucket")
    so_far = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys, "rule"))
    ranked = sketch.select(*keys, "rule", "bucket", so_far.alias("upto"), total.alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 10 >= F.col("total") * q, bucket_floor(F.col("bucket"))))
    spread = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("docs"), at(1).alias("q10"), at(5).alias("q50"), at(9).alias("q90"))
    of_rule = lambda r, x: F.max(F.when(F.col("rule") == r.name, x))
    high = lambda r: F.col("q90") + r.reach * F.greatest(F.col("q90") - F.col("q50"), F.lit(r.least))
    low = lambda r: F.col("q10") - r.reach * F.greatest(F.col("q50") - F.col("q10"), F.lit(r.least))
    limits = [of_rule(r, high(r)).alias(f"limit_{r.name}") for r in RULES] + [of_rule(r, low(r)).alias(f"floor_{r.name}") for r in RULES if r.low]
    return spread.groupBy(*keys).agg(F.max("docs").alias("docs"), *limits)


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, limit_<rule>..., floor_<rule>...): the limits that hold for each (language, source)."""
    own = materialize(sketches(measured), "quality-sketches")
    by_lang = _merge(own, "lang")
    limits = LIMITS
    group = _fences(own, "lang", "source").alias("g")
    lang = _fences(by_lang, "lang").alias("l")
    whole = _fences(_merge(by_lang.withColumn("every", F.lit(1)), "every"), "every").alias("w")
    joined = group.join(lang, F.col("g.lang").eqNullSafe(F.col("l.lang")), "left").join(F.broadcast(whole), F.lit(True), "left")
    pick = lambda c: F.when(F.col("g.docs") >= LEAST_GROUP, F.col(f"g.{c}")).when(F.col("l.docs") >= LEAST_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"w.{c}"))
    return joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *[pick(c).alias(c) for c in limits])


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``rules_failed`` (names, comma-joined) and ``kept``.

    ``limits`` is joined on (lang, source), null matching null.
    """
    on = F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source"))
    columns = [c for c in measured.columns if c not in VERDICT]
    joined = measured.alias("m").join(limits.alias("t"), on, "left")
    outside = lambda r: (F.expr(r.value) > F.col(f"limit_{r.name}")) | (F.expr(r.value) < F.col(f"floor_{r.name}") if r.low else F.lit(False))
    failed = F.concat_ws(",", *[F.when(outside(r), r.name) for r in RULES])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        joined.select(*[F.col(f"m.{c}").alias(c) for c in columns], *[F.col(f"t.{c}") for c in LIMITS])
        .select(*columns, base.alias("base_failed"), failed.alias("rules_failed"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rules_failed") == ""))
    )


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (without its text): measurements and verdict.

    An empty table gives an empty result; null languages and sources are groups
    of their own; equal rows get equal verdicts, and each counts in its group's
    sketch. A measurement equal to a limit passes.
    """
    measured = materialize(measure(docs, keep_text=False), "quality-measures")
    return judge(measured, materialize(thresholds(measured), "quality-limits"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns.

    Texts are measured a second time instead of being shuffled to a join.
    Columns named like measurements stay as they are.
    """
    limits = materialize(thresholds(measure(docs, keep_text=False)), "quality-limits")
    own = {c: f"__own_{c}" for c in docs.columns if c in (*MEASURES, *VERDICT)}  # stay what they are
    kept = judge(measure(docs.withColumnsRenamed(own)), limits).where("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
