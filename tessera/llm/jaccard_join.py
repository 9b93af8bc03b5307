"""Exact n-gram Jaccard self-join by PartEnum signatures.

A document's features are its distinct 5-word shingles. Two documents link when
100 * |A & B| >= 75 * |A | B|. The result is one row per document with the
smallest document id of its connected group.

1. **Shared features.** Feature hashes are dealt to buckets, packed (one row of
   bytes per bucket and batch), and each document learns how many of its
   features any other document holds. A link needs three quarters of a
   document's features shared, so all others leave here, with every text that
   merely quotes a common passage. Equal sets collapse to one representative.
2. **PartEnum** (Arasu, Ganti, Kaushik: "Efficient Exact Set-Similarity Joins",
   VLDB 2006) over what remains: sizes fall into bands of ratio 4/3; within the
   instance of a band the feature domain is split into partitions of three
   parts, and every union of two parts is a signature. If two sets differ in at
   most k features and one has more than k/2 partitions in which no two parts
   are empty, some partition holds at most one difference, and the two parts
   without it give both sets one signature. A set with too few such partitions
   also emits a prefix of single features, which serves pairs of two such sets.
3. **Verification.** Each set is first compared with one pivot (the candidate with
   the fewest unshared features, as the original of a group of copies has).
   What lies in different groups after that, but shares signatures, is compared
   in pairs: at once if few sets have the signature, else where two sets share
   one of the rarest features that each needs for a link. If many have that too,
   they are compared block against block; a pair is then a cell of a small
   matrix, not a row.

The features of a hot passage are counted before the shuffle, a group of equal
documents is one representative, and no group is ever expanded into its pairs
where a pivot already connects it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import ODD, as_text, distinct_per_document, mix, shingle_hashes, slices, words_of
from tessera.llm.components import connected_components
from tessera.llm.storage import bucket_count, materialize

SHINGLE = 5
#: Buckets that feature hashes are dealt to, at least; more for large tables only, as rows are dealt to each bucket for every batch.
BUCKETS = 64

_PACKED = "kind int, bucket int, docs array<bigint>, counts array<int>, data binary"
_BATCH = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("data", pa.binary())])
_DEALT = "kind int, bucket int, first bigint, gaps binary, data binary"
_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("first", pa.int64()), ("gaps", pa.binary()), ("data", pa.binary())])


def _feature_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sorted distinct feature hashes) of a batch of (doc_id, text)."""
    words = words_of(as_text(batch.column("text")), lower=True)
    starts, values = distinct_per_document(*shingle_hashes(words, SHINGLE), batch.num_rows)
    return batch.column("doc_id").to_numpy(zero_copy_only=False), starts, values


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64) of the values between consecutive starts."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[starts[1:]] - total[starts[:-1]]


def set_hashes(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell feature sets apart."""
    return _sums(mix(values), starts).view(np.int64), _sums(mix(values ^ ODD), starts).view(np.int64)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, for each key in that order whether another key equals it)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    equal = s[1:] == s[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    return order, same


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    return at, np.diff(np.concatenate((at, [len(x)])))


def _narrow(values: np.ndarray) -> bytes:
    """The values in as few bytes each (1, 2, 4 or 8) as the largest needs, behind that number."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"u{width}").tobytes()


def _widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.uint64)


def _gaps(ids: np.ndarray) -> tuple[int, bytes]:
    """The first of some ascending ids, and what each adds to the one before: few bytes for each, over however many rows the ids of a batch are dealt."""
    return int(ids[0]), _narrow(np.diff(ids.view(np.uint64), prepend=ids[:1].view(np.uint64)))


def _from_gaps(first: int, gaps: bytes) -> np.ndarray:
    return (np.cumsum(_widened(gaps), dtype=np.uint64) + np.array([first], np.int64).view(np.uint64)).view(np.int64)


def _dealt_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, each in the order of ``doc_id``."""
    for batch in batches:
        yield batch.take(pa.array(np.argsort(batch.column("doc_id").to_numpy(zero_copy_only=False), kind="stable")))


def _pack(sets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket and batch: kind 0 what is known of documents, 1 features and their documents, 2 features that are shared for sure.

    The ids of a batch ascend.
    """
    for ids, starts, values in sets:
        n = np.diff(starts)
        own = np.repeat(np.arange(len(n)), n)
        order, same = _repeated(values)
        known = np.bincount(own[order[same]], minlength=len(n))
        h1, h2 = set_hashes(starts, values)
        rows = [(0, int(values[0] % np.uint64(buckets)) if len(values) else 0, 0, None, np.concatenate([ids, n, h1, h2, known]).tobytes())]
        shared = values[order[same]]
        shared = shared[np.concatenate((np.ones(min(1, len(shared)), bool), shared[1:] != shared[:-1]))] if len(shared) else shared
        single = np.sort(order[~same])  # in the order of documents
        for kind, v, d in ((1, values[single], ids[own[single]]), (2, shared, None)):
            b = ((v >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[by], np.arange(buckets + 1))
            low = v.astype(np.uint32)[by]
            docs = d[by] if d is not None else None
            for k in range(buckets):
                lo, hi = cuts[k], cuts[k + 1]
                if hi > lo:
                    rows.append((kind, k, *((0, None) if docs is None else _gaps(docs[lo:hi])), low[lo:hi].tobytes()))
        yield _dealt_rows(rows)


def _count_shared(buckets: int):
    """How many features of each document another document has, for the buckets of one task, dealt to buckets by document."""

    def by_document(kind: int, ids: np.ndarray, told) -> pa.RecordBatch:
        """One row per bucket; ``told`` has the bytes that tell of some of the (ascending) ids."""
        b = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(b, kind="stable")
        cuts = np.searchsorted(b[by], np.arange(buckets + 1))
        parts = [(k, by[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        return _dealt_rows([(kind, k, *_gaps(ids[part]), told(part)) for k, part in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, sure = [], [], []
        for batch in batches:
            for kind, bucket, first, gaps, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                data = data.as_py()
                if kind.as_py() == 0:
                    known = np.frombuffer(data, np.int64).reshape(5, -1)
                    yield by_document(0, known[0], lambda part, known=known: known[1:, part].tobytes())
                    continue
                key = np.frombuffer(data, np.uint32).astype(np.uint64) | (np.uint64(bucket.as_py()) << np.uint64(32))
                if kind.as_py() == 2:
                    sure.append(key)
                else:
                    keys.append(key)
                    docs.append(_from_gaps(first.as_py(), gaps.as_py()))
        if keys:
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order, same = _repeated(key)
            if sure:
                same |= np.isin(key[order], np.unique(np.concatenate(sure)))
            ids, shared = np.unique(doc[order[same]], return_counts=True)
            if len(ids):
                yield by_document(1, ids, lambda part: _narrow(shared[part]))

    return run


_COUNTED = "doc_id bigint, n bigint, h1 bigint, h2 bigint, shared bigint"


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, h1, h2, shared) of the documents of one task; of rows that share a doc_id the largest set speaks."""
    known, docs, counts = [], [], []
    for batch in batches:
        for kind, first, gaps, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            docs.append(_from_gaps(first, gaps))
            if kind == 0:
                *sets, shared = np.frombuffer(data, np.int64).reshape(4, -1)
                known.append(np.stack([docs[-1], *sets]))
                counts.append(shared)
            else:
                counts.append(_widened(data).astype(np.int64))
    if known:
        rows = np.concatenate(known, axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        doc = rows[0]
        last = np.append(doc[1:] != doc[:-1], True)
        ids, total = doc[last], np.zeros(int(last.sum()), np.int64)
        np.add.at(total, np.searchsorted(ids, np.concatenate(docs)), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows[:, last], total)], names=["doc_id", "n", "h1", "h2", "shared"])


def count_features(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, shared) of every document: the size and hash of its set, and how many features some other row has too.

    ``shared`` may be too large (by chance, or for repeated rows), never too small.
    """
    buckets = bucket_count(docs, BUCKETS, spread=False)
    packed = docs.select("doc_id", "text").mapInArrow(lambda it: _pack(map(_feature_sets, _by_id(slices(it))), buckets), _DEALT)
    counted = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_count_shared(buckets), _DEALT)
    return counted.repartitionById(buckets, F.col("bucket")).mapInArrow(_sum_counts, _COUNTED)


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, starts, values = _feature_sets(batch)
        h1, h2 = set_hashes(starts, values)
        data = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(np.diff(starts).astype(np.int64)), pa.array(h1), pa.array(h2), pa.array(data, pa.binary())], names=["doc_id", "n", "h1", "h2", "data"]
        )


def _deal_features(buckets: int):
    """Features of sets as (kind, bucket, docs, counts, data) with whole hashes.

    Those that several sets of a batch have are known to be shared, however many
    sets in however many batches have them: the sets get them back at once (kind
    0, in buckets by set), and their bucket learns of each once a batch (kind 2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("data").to_pylist()]
            own = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
            values = np.concatenate([*sets, np.zeros(0, np.uint64)])
            order, same = _repeated(values)
            common, single = np.sort(order[same]), np.sort(order[~same])
            rows = []
            by_value = ((values >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            by_set = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[own]
            sure = common[np.unique(values[common], return_index=True)[1]]
            for kind, chosen, b in ((0, common, by_set), (1, single, by_value), (2, sure, by_value)):
                by = chosen[np.argsort(b[chosen], kind="stable")]
                cuts = np.searchsorted(b[by], np.arange(buckets + 1))
                for k in range(buckets):
                    part = by[cuts[k] : cuts[k + 1]]
                    if len(part):
                        at, length = _runs(own[part]) if kind < 2 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                        rows.append((kind, k, ids[own[part][at]], length.astype(np.int32), values[part].tobytes()))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=_BATCH)

    return run


def _return_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, data): the features of one bucket that more than one set has, by document."""
    keys, docs, sure = [], [], []
    for batch in batches:
        for kind, ids, counts, data in zip(*(batch.column(i) for i in (0, 2, 3, 4)), strict=True):
            values, kind = np.frombuffer(data.as_py(), np.uint64), kind.as_py()
            if kind == 2:
                sure.append(values)
                continue
            ids, counts = ids.values.to_numpy(), counts.values.to_numpy()
            if kind == 0:
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())], names=["doc_id", "data"])
            else:
                keys.append(values)
                docs.append(np.repeat(ids, counts))
    if keys:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order, same = _repeated(key)
        if sure:
            same |= np.isin(key[order], np.unique(np.concatenate(sure)))
        key, doc = key[order[same]], doc[order[same]]
        by = np.argsort(doc, kind="stable")
        key, doc = key[by], doc[by]
        at, length = _runs(doc)
        for k in range(0, len(at), 4096):
            part = range(k, min(k + 4096, len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[at[part]]), pa.array([key[at[i] : at[i] + length[i]].tobytes() for i in part], pa.binary())], names=["doc_id", "data"])


def band_limits(largest: int) -> list[int]:
    """Upper size of each band: every size in a band is at least 3/4 of the next band's... least partner bound."""
    limits, low = [], 1
    while not limits or limits[-1] < largest:
        limits.append(low * 4 // 3)
        low = limits[-1] + 1
    return limits


def _partitions(limit: int) -> int:
    """Partitions (of three parts each) of the instance whose sets have at most ``limit`` features."""
    return max(1, -(-limit // 5))


def signatures(shared: np.ndarray, n: int) -> np.ndarray:
    """PartEnum signatures of a set of ``n`` features, of which ``shared`` are in some other set."""
    limits = band_limits(n)
    own = next(i for i, x in enumerate(limits) if x >= n)
    upper = [limits[own], (limits[own] + 1) * 4 // 3]
    found, weak = [], False
    unshared = n - len(shared)
    spread = mix(shared ^ np.uint64(0xA5A5A5A55A5A5A5A))
    for tag, limit in ((own, upper[0]), (own + 1, upper[1])):
        partner = min(limit, n * 4 // 3)
        differ = (n + partner) // 7 - unshared
        if differ < 0:
            continue
        parts = _partitions(limit)
        where = (spread % np.uint64(3 * parts)).astype(np.int64)
        content = np.zeros(3 * parts, np.uint64)
        np.add.at(content, where, mix(spread))
        filled = np.bincount(where, minlength=3 * parts).reshape(parts, 3) > 0
        content = content.reshape(parts, 3)
        weak |= 2 * int((filled.sum(1) >= 2).sum()) <= differ
        index = np.arange(parts, dtype=np.uint64) * np.uint64(4) + np.uint64(tag << 40)
        for c, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            some = filled[:, a] | filled[:, b]
            found.append(mix(mix(content[some, a] * ODD + content[some, b]) + index[some] + np.uint64(c)))
    if weak:  # a link of two such sets shares one of the first few features in hash order
        allowed = n - (3 * n + 3) // 4 - unshared
        if allowed >= 0:
            found.append(mix(np.sort(spread)[: allowed + 1] + ODD))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, sigs = [], []
        for n, pieces in zip(batch.column("n").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            shared = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in pieces]))
            data.append(shared.tobytes())
            sigs.append(np.unique(signatures(shared, n)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n"), pa.array([len(x) // 8 for x in data], pa.int64()), pa.array(data, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
            names=["doc_id", "n", "s", "data", "sigs"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for na, nb, a, b in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "da", "db")), strict=True):
            common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            ok.append(100 * common >= 75 * (na + nb - common))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("data").alias("da"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("data").alias("db"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "da", "db").mapInArrow(_verify, "a bigint, b bigint")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two sides of sets, block by block: one at most for each set of a block and group of the other."""
    for batch in batches:
        for minor, other in zip(batch.column("minor"), batch.column("other"), strict=True):
            rest = list(_blocks(other.as_py()))
            for one in _blocks(minor.as_py()):
                for two in rest:
                    yield from _linked(one, two)


def _blocks(side: list[dict]) -> Iterator[list[dict]]:
    """The sets in blocks of about BLOCK_FEATURES features."""
    ends = np.cumsum([len(x["data"]) // 8 for x in side])
    cuts = np.searchsorted(ends // BLOCK_FEATURES, np.arange(ends[-1] // BLOCK_FEATURES + 2))
    return (side[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)


def _linked(minor: list[dict], other: list[dict]) -> Iterator[pa.RecordBatch]:
    left = [np.frombuffer(x["data"], np.uint64) for x in minor]
    right = [np.frombuffer(x["data"], np.uint64) for x in other]
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    counts = _incidence(left, common) @ _incidence(right, common).T
    na, nb = (np.array([x["n"] for x in side], np.int64) for side in (minor, other))
    ga, gb = (np.array([x["g"] for x in side], np.int64) for side in (minor, other))
    counts = counts.astype(np.int64)
    close = (100 * counts >= 75 * (na[:, None] + nb[None, :] - counts)) & (ga[:, None] != gb[None, :])
    i, j = np.nonzero(close)
    if len(i):
        _, once = np.unique(np.stack([i, gb[j]]), axis=1, return_index=True)
        ids = [np.array([x["doc_id"] for x in side], np.int64) for side in (minor, other)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[0][i[once]]), pa.array(ids[1][j[once]])], names=["a", "b"])


def _incidence(sets: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    """A 0/1 matrix: which of the values in ``common`` each set has."""
    matrix = np.zeros((len(sets), len(common)), np.float32)
    for k, s in enumerate(sets):
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            matrix[k, at[common[at] == s]] = 1
    return matrix


#: Sets in different groups that share a signature are compared in pairs if the signature has no more sets than this.
FEW = 24
#: Features in one block of sets that a task compares with another block.
BLOCK_FEATURES = 40_000
#: Blocks on each side of a row that a task gets: more of them, and sets are sent to fewer tasks.
SIDE = 8


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sig): the features of sets, a row each."""
    for batch in batches:
        for ids, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
            values = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), ids, np.int64)), pa.array(values)], names=["doc_id", "sig"])


def _rare_features(many: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, doc_id, n, s, g): the rarest features of the sets (doc_id, g) in ``many``, one of which two similar sets of different groups share.

    Features of a single group count for nothing here. Of the others a set needs
    three quarters of its size, so it shares one of those beyond the rest of
    them with what it links to, whatever the order; rare ones are in few sets.
    """
    members = materialize(many.select("doc_id", "g").distinct().join(sets.select("doc_id", "n", "data"), "doc_id"), "jaccard-many")
    features = members.select("doc_id", "data").mapInArrow(_features, "doc_id bigint, sig bigint").join(members.select("doc_id", "g", "n"), "doc_id")
    open_ = features.groupBy("sig").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("of")).where("low < high")
    told = features.join(open_.select("sig", "of"), "sig").groupBy("doc_id", "g", "n").agg(F.sort_array(F.collect_list(F.struct("of", "sig"))).alias("all"))
    spare = (F.size("all") - F.floor((3 * F.col("n") + 3) / 4) + 1).cast("int")
    first = told.withColumn("s", F.size("all").cast("long")).withColumn("all", F.slice("all", 1, F.greatest(spare, F.lit(0))))
    return first.select(F.explode("all.sig").alias("sig"), "doc_id", "n", "s", "g")


def _crossing_links(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets of different groups that share a signature.

    ``grouped`` has (sig, doc_id, n, s, g). The sets of a signature that few
    share are compared in pairs. The others, and what has a text in common with
    many, are compared where they share one of their rarest features: in pairs
    again where few have it. Groups that share such a feature with many form
    clusters; in each, every set outside the cluster's largest group is compared
    with all others, block against block, so that pairs exist only as cells of a
    count matrix in a task.
    """
    few, many = _few_and_many(grouped)
    rare, common = _few_and_many(_rare_features(many, sets))
    return verified(few.unionByName(rare).distinct(), sets).unionByName(_cluster_links(common, sets))


def _few_and_many(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of different groups that share a signature with few others, and (doc_id, g, low) of the sets that share one with many."""
    mixed = grouped.groupBy("sig").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("k")).where("low < high")
    mixed = materialize(grouped.join(mixed.select("sig", "low", "k"), "sig"), "jaccard-mixed")
    sides = [mixed.where(F.col("k") <= FEW).select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "s", "g")]) for x in "ab"]
    bound = F.expr("g_a < g_b AND 100 * least(s_a, s_b) >= 75 * (n_a + n_b - least(s_a, s_b))")
    few = sides[0].join(sides[1], (sides[0]["sig"] == sides[1]["sig"]) & bound).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
    return few, mixed.where(F.col("k") > FEW).select("doc_id", "g", "low").distinct()


def _cluster_links(many: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets (doc_id) of different groups (g) that lie in one cluster; (g, low) are the edges between groups."""
    touching = many.select("g", "low").distinct()
    clusters = materialize(connected_components(touching).withColumnRenamed("id", "g").withColumnRenamed("component", "c"), "jaccard-clusters")
    own = many.select("doc_id", "g").distinct().join(clusters, "g")
    members = materialize(own.join(sets.select("doc_id", "n", "s", "data"), "doc_id"), "jaccard-members")
    sizes = members.groupBy("c", "g").agg(F.count("*").alias("k"), F.sum("s").alias("s"))
    total = sizes.groupBy("c").agg(F.sum("s").alias("s"), F.max_by("g", F.struct("k", "g")).alias("largest"))
    total = total.select("c", "largest", F.ceil(F.col("s") / (BLOCK_FEATURES * SIDE)).alias("blocks"))
    placed = members.join(total, "c").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    fields = F.collect_list(F.struct("doc_id", "g", "n", "data"))
    other = placed.groupBy("c", "block").agg(fields.alias("other"))
    minor = placed.where("g <> largest AND 100 * s >= 75 * n").groupBy("c", "block", "blocks").agg(fields.alias("minor"))
    # no task has all pairs of a cluster: they are dealt by both of their sides in turn
    to = minor.select("c", F.col("block").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    pairs = to.join(other, ["c", "block"]).join(minor.select("c", F.col("block").alias("of"), "minor"), ["c", "of"])
    return pairs.select("minor", "other").mapInArrow(_block_links, "a bigint, b bigint")


def links(sets: DataFrame) -> DataFrame:
    """Enough links (a, b) between ``sets`` to connect whatever is connected."""
    signed = materialize(sets.select("doc_id", "n", "s", F.explode("sigs").alias("sig")), "jaccard-signatures")
    best = F.struct((F.col("n") - F.col("s")).alias("u"), "doc_id")
    buckets = signed.groupBy("sig").agg(F.min(best).alias("pivot"), F.count("*").alias("k")).where("k > 1").select("sig", "pivot")
    pivots = signed.join(buckets, "sig").groupBy("doc_id").agg(F.min("pivot").alias("pivot"))
    first = pivots.select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b")).where("a <> b")
    first = materialize(verified(first, sets), "jaccard-first")
    groups = connected_components(first).select(F.col("id").alias("doc_id"), F.col("component").alias("g"))
    grouped = signed.join(materialize(groups, "jaccard-groups"), "doc_id", "left").select("sig", "doc_id", "n", "s", F.coalesce("g", "doc_id").alias("g"))
    return first.unionByName(_crossing_links(grouped, sets))


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per distinct ``doc_id``.

    Null and blank texts have the empty set and are linked with nothing. Rows
    without a ``doc_id`` identify no document and are left out. Where rows share
    a ``doc_id``, the text with the most shingles speaks for it. Further columns
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    counted = materialize(count_features(docs), "jaccard-counts")
    classes = counted.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared"))
    classes = materialize(classes, "jaccard-classes")
    chosen = classes.where("n >= 3 AND 100 * shared >= 75 * n").select(F.col("rep").alias("doc_id"), "h1", "h2")
    sets = docs.join(chosen.select("doc_id"), "doc_id", "left_semi").mapInArrow(_packed_sets, "doc_id bigint, n bigint, h1 bigint, h2 bigint, data binary")
    sets = materialize(sets.join(chosen, ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "data"), "jaccard-sets")
    buckets = bucket_count(sets, BUCKETS, "data", spread=False)
    dealt = sets.select("doc_id", "data").mapInArrow(_deal_features(buckets), _PACKED).repartitionById(buckets, F.col("bucket")).mapInArrow(_return_shared, "doc_id bigint, data binary")
    pieces = dealt.groupBy("doc_id").agg(F.collect_list("data").alias("pieces"), F.sum(F.length("data") / 8).alias("s"))
    near = sets.select("doc_id", "n").join(pieces, "doc_id").where("100 * s >= 75 * n").select("doc_id", "n", "pieces")
    signed = materialize(near.mapInArrow(_sign, "doc_id bigint, n bigint, s bigint, data binary, sigs array<bigint>"), "jaccard-signed")
    groups = connected_components(links(signed)).select(F.col("id").alias("rep"), "component")
    of_class = classes.join(groups, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    joined = counted.join(of_class, ["n", "h1", "h2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
