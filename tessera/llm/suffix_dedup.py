"""Removal of repeated 200-byte strings by prefix-free parsing.

In prefix-free parsing (Boucher et al., "Prefix-free parsing for building big
BWTs", 2019) occurrences of trigger strings, chosen by a rolling hash, cut a
text into phrases that overlap by a trigger, so that no phrase suffix is a
prefix of another. The order of all suffixes then follows from two smaller
orders: suffixes of dictionary phrases up to the next trigger, and what follows
that trigger in the parse.

Here triggers are 100-byte strings whose hash is the least of the 101 in some
200-byte window, so every window holds one, and equal windows hold the same one
at the same place. The work is spread as follows.

1. Tasks parse texts and deal triggers, packed, to buckets by hash. A trigger
   seen once ends no repeated string. A trigger whose whole surroundings recur
   is settled at once; highly repetitive text ends here.
2. For the rest, the surroundings of equal triggers meet: the phrase ends to
   their left are sorted into a suffix array of the dictionary, what follows to
   their right into one of the parse (as far as 200 bytes reach), each with the
   common prefixes of neighbours. Two windows at distance o before the trigger
   are equal exactly if they share a class of at least o bytes in the first
   order and of 200 - o in the second.
3. A trigger with very many different surroundings would fill one task. Its
   windows are dealt by their own hash instead.

All decisions are about the input, so the result does not depend on any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import as_text, mix, slices
from tessera.llm.storage import bucket_count, materialize

#: Length of the strings that are removed where they repeat.
LENGTH = 200
#: Length of triggers; each window of LENGTH bytes has WINDOW of them.
TRIGGER = 100
WINDOW = LENGTH - TRIGGER + 1
#: Bytes parsed at once; longer documents are parsed in pieces.
PIECE = 1 << 20
#: Different surroundings of one trigger that are sorted in one task.
SORTED = 4096
BUCKETS = 64

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = np.uint64((1 << 23) - 1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        ones = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        for x in ones:
            x[0] = 1
        _powers[:] = [np.cumprod(x, dtype=np.uint64) for x in ones]
    return _powers[0][:n], _powers[1][:n]


class Hashes:
    """Hashes of all substrings of a byte array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:-1], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours (van Herk)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _triggers(data: np.ndarray, windows: np.ndarray) -> tuple[Hashes, np.ndarray, np.ndarray]:
    """(hashes, positions, trigger hashes) of the triggers of the windows of ``data`` marked by their starts."""
    hashes = Hashes(data)
    grams = mix(hashes.grams(TRIGGER))
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(keys, WINDOW)[: len(windows)]
    chosen = np.zeros(len(grams), bool)
    chosen[(least[windows[: len(least)]] & _POSITION).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return hashes, at, grams[at]


def _parse(keys: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, position, trigger, surroundings) of the triggers of documents, a piece of text at a time."""
    batch: list[tuple[int, int, int, int, int]] = []  # document, begin and end of its bytes here, begin and end of those whose triggers are given here
    size = 0

    def parse():
        data = np.frombuffer(b"".join(texts[d][b:e] for d, b, e, *_ in batch), np.uint8)
        if len(data) < LENGTH:
            return
        edge = np.concatenate(([0], np.cumsum([e - b for _, b, e, *_ in batch])))
        marks = np.zeros(len(data) + 1, np.int32)
        for i in range(len(batch)):
            if edge[i + 1] - edge[i] >= LENGTH:
                marks[edge[i]] += 1
                marks[edge[i + 1] - LENGTH + 1] -= 1
        windows = np.cumsum(marks)[: len(data) - LENGTH + 1] > 0
        hashes, at, trigger = _triggers(data, windows)
        piece = np.searchsorted(edge, at, "right") - 1
        doc = np.array([x[0] for x in batch])[piece]
        shift = np.array([x[1] for x in batch])[piece] - edge[piece]
        total = np.array([len(texts[x[0]]) for x in batch])[piece]
        position = at + shift
        left, right = np.minimum(position, TRIGGER), np.minimum(total - position, LENGTH)
        own_begin, own_end = (np.array([x[i] for x in batch])[piece] for i in (3, 4))
        own = (position >= own_begin) & (position < own_end)  # else another piece gives it; the overlap holds all of its surroundings here
        at, position, left, right, doc, trigger = (x[own] for x in (at, position, left, right, doc, trigger))
        around = mix(hashes.of(at - left, at + right) + (left * 1024 + right).astype(np.uint64))
        yield keys[doc], position, trigger, around

    for d, text in enumerate(texts):
        step = PIECE if len(text) > PIECE else max(1, len(text))
        for begin in range(0, len(text), step):
            if len(text) < LENGTH:
                break
            b, e = max(0, begin - 2 * LENGTH), min(len(text), begin + step + 2 * LENGTH)
            batch.append((d, b, e, begin, begin + step))
            size += e - b
            if size >= PIECE:
                yield from parse()
                batch, size = [], 0
    if batch:
        yield from parse()


_PACKED = "bucket int, docs array<bigint>, counts array<int>, data binary"


def _deal(buckets: int):
    """Triggers of texts, packed by bucket: for each document trigger (4 bytes), position (4) and hash of surroundings (8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_text(batch.column("text")).cast(pa.large_binary()).to_pylist()
            found = list(_parse(batch.column("key").to_numpy(), texts))
            if not found:
                continue
            key, position, trigger, around = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = ((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                part = order[cuts[k] : cuts[k + 1]]
                if len(part):
                    docs, counts = np.unique(key[part], return_counts=True)
                    rows.append((k, docs, counts.astype(np.int32), trigger[part].astype(np.uint32).tobytes() + position[part].astype(np.uint32).tobytes() + around[part].tobytes()))
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "docs", "counts", "data"])

    return run


#: What is to be done about a trigger: its whole surroundings recur; they are to be sorted; its windows are to be dealt out.
WHOLE, SORT, DEAL = 1, 2, 4


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, positions, what): the recurring triggers of each document, for the buckets of one task."""
    triggers, positions, around, keys = [], [], [], []
    for batch in batches:
        for bucket, docs, counts, data in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = data.as_py()
            n = len(data) // 16
            triggers.append(np.frombuffer(data, np.uint32, n).astype(np.uint64) | (np.uint64(bucket.as_py()) << np.uint64(32)))
            positions.append(np.frombuffer(data, np.uint32, n, 4 * n))
            around.append(np.frombuffer(data, np.uint64, n, 8 * n))
            keys.append(np.repeat(docs.values.to_numpy(), counts.values.to_numpy()))
    if not triggers:
        return
    trigger, position, context, key = (np.concatenate(x) for x in (triggers, positions, around, keys))
    order = np.lexsort((position, key, context, trigger))
    t, c = trigger[order], context[order]
    new_t = np.concatenate(([True], t[1:] != t[:-1]))
    new_c = new_t | np.concatenate(([True], c[1:] != c[:-1]))
    group, cls = np.cumsum(new_t) - 1, np.cumsum(new_c) - 1
    members, classes = np.bincount(cls), np.bincount(group[new_c])
    whole = members[cls] > 1
    several = classes[group] > 1
    many = classes[group] > SORTED
    # one of each class stands for it where classes are compared
    what = whole * WHOLE + (several & ~many & new_c) * SORT + (several & many & new_c) * DEAL
    kept = what > 0
    by = np.argsort(key[order][kept], kind="stable")
    k, p, w = key[order][kept][by], position[order][kept][by].astype(np.int64), what[kept][by].astype(np.int64)
    at = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)])) if len(k) else np.zeros(1, np.int64)
    for a in range(0, len(at) - 1, 8192):
        cut = at[a : a + 8193]
        values = pa.array((p * 8 + w)[cut[0] : cut[-1]])
        yield pa.RecordBatch.from_arrays([pa.array(k[cut[:-1]]), pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), values)], names=["key", "todo"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigger, key, position, left, right): surroundings that are to be sorted, left parts backwards from the trigger."""
    for batch in batches:
        rows = []
        for key, text, todo in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("todo").to_pylist(), strict=True):
            for p in sorted({x >> 3 for part in todo for x in part if x & SORT}):
                trigger = text[p : p + TRIGGER]
                rows.append((int.from_bytes(hashlib.blake2b(trigger, digest_size=8).digest(), "little", signed=True), key, p, text[max(0, p - TRIGGER) : p][::-1], text[p : p + LENGTH]))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["trigger", "key", "position", "left", "right"])


def _suffix_order(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common bytes with the one before) of byte rows within groups; -1 where a group begins."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    columns = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*columns.T[::-1], group))
    sorted_rows, g = rows[order], group[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[g[1:] != g[:-1]] = -1
    return order, np.concatenate(([-1], common))


def repeated_windows(group: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each trigger occurrence the least and greatest distance o at which the window that starts o bytes before it is repeated in its group; -1 if none."""
    n = len(group)
    l_len, r_len = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    spread = lambda xs, w: np.frombuffer(b"".join(x.ljust(w, b"\0") for x in xs), np.uint8).reshape(n, w)
    (l_order, l_common), (r_order, r_common) = _suffix_order(group, spread(left, TRIGGER)), _suffix_order(group, spread(right, LENGTH))
    first, last = np.full(n, -1), np.full(n, -1)
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for o in range(WINDOW):
        classes[0][l_order] = np.cumsum(l_common < o)
        classes[1][r_order] = np.cumsum(r_common < LENGTH - o)
        valid = np.flatnonzero((l_len >= o) & (r_len >= LENGTH - o))
        key = classes[0][valid] * (n + 1) + classes[1][valid]
        order = np.argsort(key, kind="stable")
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(valid), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        hit = valid[twice]
        first[hit] = np.where(first[hit] < 0, o, first[hit])
        last[hit] = o
    return first, last


#: Surroundings sorted at once; groups are not split.
SLAB = 16_384


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, end) of repeated stretches, from surroundings in the order of their triggers."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        group = np.unique(table.column("trigger").to_numpy(), return_inverse=True)[1]
        first, last = repeated_windows(group, table.column("left").to_pylist(), table.column("right").to_pylist())
        hit = np.flatnonzero(last >= 0)
        position = table.column("position").to_numpy()[hit]
        return pa.RecordBatch.from_arrays([pa.array(table.column("key").to_numpy()[hit]), pa.array(position - last[hit]), pa.array(position - first[hit] + LENGTH)], names=["key", "start", "end"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= SLAB:
            table = pa.Table.from_batches(waiting)
            trigger = table.column("trigger").to_numpy()
            cut = int(np.flatnonzero(trigger == trigger[-1])[0])
            if cut:
                yield spans(table.slice(0, cut))
                waiting = table.slice(cut).combine_chunks().to_batches()
    if waiting:
        yield spans(pa.Table.from_batches(waiting))


def _dealt_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, key, start) of the windows around triggers with too many different surroundings."""
    for batch in batches:
        for key, text, todo in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("todo").to_pylist(), strict=True):
            starts = sorted({s for part in todo for x in part if x & DEAL for s in range(max(0, (x >> 3) - TRIGGER), min(x >> 3, len(text) - LENGTH) + 1)})
            if starts:
                halves = np.array([np.frombuffer(hashlib.blake2b(text[s : s + LENGTH], digest_size=16).digest(), np.int64) for s in starts])
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.full(len(starts), key, np.int64)), pa.array(np.array(starts, np.int64))], names=["h1", "h2", "key", "start"])


_CUT = "key bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, todo, spans in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("todo").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            n = len(text)
            marks = np.zeros(n + 1, np.int64)
            whole = np.array([x >> 3 for part in todo for x in part if x & WHOLE], np.int64)
            begin, end = np.maximum(0, whole - TRIGGER), np.minimum(n, whole + LENGTH)
            long = end - begin >= LENGTH
            np.add.at(marks, begin[long], 1)
            np.add.at(marks, end[long], -1)
            for s in spans or ():
                marks[s["start"]] += 1
                marks[s["end"]] -= 1
            gone = np.cumsum(marks[:n]) > 0
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((key, int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns) with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes; null where nothing is removed).

    A null text is empty. Repeated rows are documents of their own, so all of
    their strings of 200 bytes repeat. Rows are identified inside by a hash of
    id and text, so ids may be null or shared. Columns of the new names are
    replaced; an empty table gives an empty result.
    """
    aside = ("n_bytes", "n_removed", "n_spans", "kept", "__key")
    docs = docs.select(*[c for c in docs.columns if c not in aside])
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    texts = keyed.where(F.octet_length("text") >= LENGTH).select(F.col("__key").alias("key"), "text")
    buckets = bucket_count(docs, BUCKETS)
    dealt = texts.mapInArrow(_deal(buckets), _PACKED).repartition(buckets, "bucket")
    todo = dealt.mapInArrow(_recurring, "key bigint, todo array<bigint>").groupBy("key").agg(F.collect_list("todo").alias("todo"))
    todo = materialize(todo, "suffix-todo")
    touched = materialize(texts.join(todo, "key"), "suffix-texts")
    surroundings = touched.mapInArrow(_contexts, "trigger bigint, key bigint, position bigint, left binary, right binary")
    spans = surroundings.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_sorted_spans, "key bigint, start bigint, end bigint")
    windows = touched.mapInArrow(_dealt_windows, "h1 bigint, h2 bigint, key bigint, start bigint")
    repeated = windows.groupBy("h1", "h2").agg(F.count("*").alias("k")).where("k > 1").select("h1", "h2")
    hot = windows.join(repeated, ["h1", "h2"]).groupBy("key", "start").agg(F.max(F.col("start") + LENGTH).alias("end"))
    found = spans.unionByName(hot).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = touched.join(found, "key", "left").select("key", "text", "todo", "spans").mapInArrow(_cut, _CUT)
    cut = materialize(cut.dropDuplicates(["key"]).where("n_removed > 0").withColumnRenamed("key", "__key"), "suffix-cut")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(F.octet_length("text").cast("long"), none).alias("n_bytes"), *[F.coalesce(c, none).alias(c) for c in ("n_removed", "n_spans")]]
    return keyed.join(cut, "__key", "left").select(*[F.col(c) for c in docs.columns], *counts, "kept")
