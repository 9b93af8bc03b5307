"""Stupid-backoff language-model scores of documents (Brants et al., EMNLP 2007).

The model is counted from the corpus itself: words, and pairs of neighbouring
words seen at least twice. A word scores count(pair) / count(previous word) if
its pair is in the table, and otherwise 0.4 * count(word) / number of words (no
factor for the first word of a document). A document's score is the sum of the
logarithms.

Count tables are partitioned by hash, and the pairs of all documents are dealt
to those partitions, packed: (second word, first word) with their documents go
to the bucket of the second word, where both its count and the pair's are
known. What still needs the count of the first word goes on to that word's
bucket. Words with one in FREQUENT of all occurrences (so at most FREQUENT
words) are known everywhere, and their pairs are dealt by both words,
so no bucket depends on one frequent word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import ODD, as_text, mix, slices, words_of
from tessera.llm.storage import bucket_count, materialize

BACKOFF = 0.4
#: Occurrences of a pair before it is in the table.
LEAST_PAIRS = 2
#: Words with at least one in this many occurrences are frequent.
FREQUENT = 4000
BUCKETS = 32

_PACKED = "bucket int, docs array<bigint>, counts array<int>, data binary"
_NAMES = ["bucket", "docs", "counts", "data"]


def _word_ids(batch: pa.RecordBatch):
    words = words_of(as_text(batch.column("text")), lower=True)
    # 0 stands for no word
    return words, np.maximum(words.hashes(), np.uint64(1))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word (by hash) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, ids = _word_ids(batch)
            counts = np.bincount(words.ids, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(counts)], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _packed_rows(bucket: np.ndarray, doc: np.ndarray, buckets: int, word: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    """One row per bucket. In ``data`` are its documents, the lengths of runs of one word, the runs' words, each element's document (by number) and its other words; ``counts`` has the numbers of runs and documents.

    Other words are numbers too, of the distinct ones in the row; how many these are stands first.
    Words and documents are sorted, so their differences are kept, and ``data`` is compressed.
    """
    order = np.lexsort((word, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for k in range(buckets):
        part = order[cuts[k] : cuts[k + 1]]
        if len(part):
            ids, number = np.unique(doc[part], return_inverse=True)
            at = np.concatenate(([0], np.flatnonzero(np.diff(word[part])) + 1))
            runs = np.diff(np.concatenate((at, [len(part)])))
            told = [np.unique(c[part], return_inverse=True) for c in others]
            parts = [np.array([len(u) for u, _ in told], np.int64).tobytes(), _planes(runs.astype(np.uint32)), _differences(ids.view(np.uint64)), _differences(word[part[at]]), _planes(number.astype(_numbers(len(ids))))]
            parts += [x for u, i in told for x in (_differences(u), _planes(i.astype(_numbers(len(u)))))]
            rows.append((k, [], [len(runs), len(ids)], _compressed(b"".join(parts))))
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then their second ones, and so on: equal high bytes compress well side by side."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(raw: np.ndarray, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _differences(ascending: np.ndarray) -> bytes:
    return _planes(np.diff(ascending, prepend=np.zeros(1, np.uint64)))


def _compressed(data: bytes) -> bytes:
    """Compressed bytes behind their length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _numbers(documents: int) -> type[np.unsignedinteger]:
    """The type of numbers of so many things in a packed row."""
    return np.uint8 if documents <= 1 << 8 else np.uint16 if documents <= 1 << 16 else np.uint32


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, ...]:
    """(doc, column...) of all packed rows of a task."""
    docs, columns = [], [[] for _ in range(width)]
    for batch in batches:
        for counts, data in zip(batch.column("counts"), batch.column("data"), strict=True):
            (run_count, id_count), raw, at = counts.as_py(), np.frombuffer(_plain(data.as_py()), np.uint8), 0

            def take(kind: type, count: int) -> np.ndarray:
                nonlocal at
                part = raw[at : at + count * np.dtype(kind).itemsize]
                at += len(part)
                return _from_planes(part, kind)

            sizes = raw[: 8 * (width - 1)].view(np.int64)
            at += 8 * (width - 1)
            runs = take(np.uint32, run_count)
            n = int(runs.sum())
            ids = np.cumsum(take(np.uint64, id_count)).view(np.int64)
            columns[0].append(np.repeat(np.cumsum(take(np.uint64, run_count)), runs))
            docs.append(ids[take(_numbers(len(ids)), n)])
            for k, size in enumerate(sizes.tolist(), 1):
                distinct = np.cumsum(take(np.uint64, size))
                columns[k].append(distinct[take(_numbers(size), n)])
    join = lambda xs, t: np.concatenate([*xs, np.zeros(0, t)])
    return join(docs, np.int64), *(join(c, np.uint64) for c in columns)


def _counted(keys: np.ndarray) -> np.ndarray:
    """How often each element of ``keys`` occurs among them."""
    _, where, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[where]


class Frequent:
    """The counts of frequent words, for tasks."""

    def __init__(self, words: list[int], counts: list[int], total: int):
        order = np.argsort(np.array(words, np.uint64)) if words else []
        self.words, self.counts, self.total = np.array(words, np.uint64)[order], np.array(counts, np.int64)[order], total

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, 0 if it is not frequent."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _deal_pairs(frequent, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, ids = _word_ids(batch)
            second = ids[words.ids]
            first = np.concatenate((np.zeros(1, np.uint64), second[:-1]))[: len(second)]
            first[words.starts[:-1][words.counts > 0]] = 0
            spread = np.where(frequent.value(second) > 0, mix(second * ODD + first), mix(second))
            doc = batch.column("key").to_numpy()[words.documents()]
            yield _packed_rows((spread % np.uint64(buckets)).astype(np.int64), doc, buckets, second, first)

    return run


def _pair_scores(batches: Iterator[pa.RecordBatch], frequent: Frequent):
    """(doc, first word, seen, score so far) of all pairs of a task; a seen pair still lacks the count of an infrequent first word."""
    doc, second, first = _unpacked(batches, 2)
    pairs = _counted(mix(second * ODD + first))
    count = frequent(second)
    rare = count == 0
    count[rare] = _counted(second[rare])
    seen = (pairs >= LEAST_PAIRS) & (first > 0)
    score = np.log(count / frequent.total) + np.where(first > 0, math.log(BACKOFF), 0.0)
    score[seen] = np.log(pairs[seen])
    known = frequent(first)
    done = seen & (known > 0)
    score[done] -= np.log(known[done])
    return doc, first, seen & (known == 0), score


_SUMS = "key bigint, n bigint, score double"


def _sums(doc: np.ndarray, score: np.ndarray, weight: int) -> Iterator[pa.RecordBatch]:
    if len(doc):
        ids, where = np.unique(doc, return_inverse=True)
        n = np.bincount(where) * weight
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(np.bincount(where, score))], names=["key", "n", "score"])


def _score_pairs(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, _, _, score = _pair_scores(batches, frequent.value)
        yield from _sums(doc, score, 1)

    return run


def _pass_on(frequent, buckets: int):
    """The first words whose counts are still to be divided by, dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, first, open_, _ = _pair_scores(batches, frequent.value)
        doc, first = doc[open_], first[open_]
        yield _packed_rows((mix(first) % np.uint64(buckets)).astype(np.int64), doc, buckets, first)

    return run


def _table_rows(buckets: int):
    """A count table as packed rows: words in ``data``, counts in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, c = batch.column("word").to_numpy().view(np.uint64), batch.column("c").to_numpy()
            bucket = (mix(word) % np.uint64(buckets)).astype(np.int64)
            rows = [(k, c[p], [], word[p].tobytes()) for k in range(buckets) if len(p := np.flatnonzero(bucket == k))]
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)

    return run


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minus the logarithm of the count of each word that was passed on, summed by document."""
    words, counts, rest = [], [], []
    for batch in batches:
        table = np.array([len(x) == 0 for x in batch.column("counts")])
        for c, data in zip(batch.column("docs").filter(pa.array(table)), batch.column("data").filter(pa.array(table)), strict=True):
            counts.append(c.values.to_numpy())
            words.append(np.frombuffer(data.as_py(), np.uint64))
        rest.append(batch.filter(pa.array(~table)))
    doc, first = _unpacked(iter(rest), 1)
    if len(doc):
        word, count = np.concatenate(words), np.concatenate(counts)
        order = np.argsort(word)
        yield from _sums(doc, -np.log(count[order][np.searchsorted(word[order], first)]), 0)


def score(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``n_words`` and ``score`` (natural logarithm; 0 for no words).

    Null texts have no words. Rows are identified inside by a hash of id and
    text, so ids may be null or shared; repeated rows count as often as they
    occur and each gets its own score. Columns of the new names are replaced.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    copies = keyed.groupBy("__key").agg(F.count("*").alias("__copies"))
    texts = keyed.select(F.col("__key").alias("key"), "text")
    counts = materialize(word_counts(docs), "lm-words")
    total = counts.agg(F.sum("c")).first()[0] or 1
    often = counts.where(F.col("c") * FREQUENT >= total).collect()  # FREQUENT rows at most
    frequent = spark.sparkContext.broadcast(Frequent([r["word"] % (1 << 64) for r in often], [r["c"] for r in often], total))
    buckets = bucket_count(docs, BUCKETS)
    pairs = texts.mapInArrow(_deal_pairs(frequent, buckets), _PACKED).repartitionById(buckets, F.col("bucket"))
    direct = pairs.mapInArrow(_score_pairs(frequent), _SUMS)
    open_ = pairs.mapInArrow(_pass_on(frequent, buckets), _PACKED)
    table = counts.where(F.col("c") >= LEAST_PAIRS).mapInArrow(_table_rows(buckets), _PACKED)
    later = open_.unionAll(table).repartitionById(buckets, F.col("bucket")).mapInArrow(_divide, _SUMS)
    summed = direct.unionAll(later).groupBy("key").agg(F.sum("n").alias("n"), F.sum("score").alias("s"))
    aside = ("text", "n_words", "score")
    joined = keyed.drop(*aside).join(summed.withColumnRenamed("key", "__key"), "__key", "left").join(copies, "__key")
    per_copy = lambda c, zero: F.coalesce(F.col(c) / F.col("__copies"), F.lit(zero))
    return joined.withColumns({"n_words": per_copy("n", 0.0).cast("long"), "score": per_copy("s", 0.0)}).drop("__key", "__copies", "n", "s")
