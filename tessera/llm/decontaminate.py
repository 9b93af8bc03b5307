"""Benchmark decontamination by q-gram filtering and banded alignment.

A benchmark item leaks into a document if a region of the document matches a
window of the item (the whole item, if it is short) within an edit budget.

By the q-gram lemma (Jokinen and Ukkonen 1991) two texts of length m at edit
distance e share at least m - q + 1 - q*e q-grams, on diagonals at most e
apart. Shared q-grams of a document and an item are therefore counted in
overlapping diagonal bands (Rasmussen, Stoye, Myers, "Efficient q-gram filters
for finding all epsilon-matches over a given length", 2006); only regions whose
count meets the bound are verified, by an alignment confined to the band.

Documents are read once for each block of items; a block's q-gram index has a
fixed largest size, so the index is sent to the executors whatever the size of
the benchmark, and documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import as_text, slices

#: Length of grams, in bytes of normalised text.
Q = 8
#: Length of the item windows that are looked for, in bytes; shorter items are windows as a whole.
LENGTH = 64
#: Windows start at multiples of this in an item, and at its last place; a match longer by this holds one.
STEP = 8
#: Edits allowed in a hundred bytes.
RATE = 8
#: Items with fewer normalised bytes could match ordinary prose by edits; they are looked for as they stand, between blanks.
LEAST = 32
#: Shared grams that are expanded at once, and the bytes of text by which slices of them overlap.
HITS = 200_000
OVERLAP = 4 * LENGTH
#: Distances remembered for one text.
KNOWN = 100_000
#: Bytes of items in one block.
BLOCK_BYTES = 2 << 20

_FOLD = bytes(0x20 if c < 0x30 or 0x39 < c < 0x41 or 0x5A < c < 0x61 or 0x7A < c < 0x80 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FILTER_BITS = 22
_CELLS = 1 << 14


def normalize(text: str) -> bytes:
    """UTF-8 with A-Z lowered and runs of other ASCII but letters and digits as one blank."""
    return b" ".join(text.encode().translate(_FOLD).split())


def _grams(data: np.ndarray) -> np.ndarray:
    """The q-grams of a byte array as integers."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.as_strided(data, (len(data) - Q + 1, Q), (1, 1)).copy().view(np.uint64).ravel()


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def edits_allowed(length: int) -> int:
    return length * RATE // 100


@dataclass
class GramIndex:
    """Sorted q-grams of a block of items, with the item and offset of each occurrence."""

    grams: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    ids: list[int]
    texts: list[bytes]
    whole: ahocorasick.Automaton | None

    @staticmethod
    def build(all_items: list[tuple[int, bytes]]) -> GramIndex:
        items = [x for x in all_items if len(x[1]) >= LEAST]
        short: dict[bytes, list[int]] = {}
        for item_id, text in all_items:
            if 0 < len(text) < LEAST:
                short.setdefault(text, []).append(item_id)
        whole = ahocorasick.Automaton() if short else None
        for text, ids in short.items():
            whole.add_word(f" {text.decode('latin-1')} ", (ids, len(text)))
        if whole is not None:
            whole.make_automaton()
        parts = [_grams(np.frombuffer(t, np.uint8)) for _, t in items]
        grams = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(p) for p in parts])
        offset = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(grams, kind="stable")
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[_slot(grams)] = True
        return GramIndex(grams[order], item[order], offset[order], present, [i for i, _ in items], [t for _, t in items], whole)

    def hits(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the text, item, offset in the item) of all shared q-grams, for slices of the text with about HITS of them.

        Slices overlap by what a window and its edits reach, so each window's hits are in one slice.
        """
        grams = _grams(text)
        at = np.flatnonzero(self.filter[_slot(grams)])
        low = np.searchsorted(self.grams, grams[at], "left")
        count = np.searchsorted(self.grams, grams[at], "right") - low
        some = count > 0
        at, low, count = at[some], low[some], count[some]
        so_far = np.concatenate(([0], np.cumsum(count)))
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(so_far, so_far[begin] + HITS, "right")) - 1)
            reach = int(np.searchsorted(at, at[end - 1] + OVERLAP, "right"))
            a, lo, c = at[begin:reach], low[begin:reach], count[begin:reach]
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            where = np.repeat(lo, c) + nth
            yield np.repeat(a, c), self.item[where], self.offset[where]
            begin = end


def band_distance(a: bytes, b: bytes, band: int, most: int) -> int:
    """Fewest edits that turn ``a`` into some stretch of ``b``, with up to ``band`` of ``b`` unused at either end.

    One row of the alignment at a time, restricted to diagonals within the band;
    insertions along a row are a running minimum. Gives up, with a number over
    ``most``, as soon as no cell of a row is within ``most``.
    """
    width = len(b) - len(a) + 2 * band + 1
    if width <= 0:
        return len(a)
    y = np.frombuffer(b, np.uint8)
    steps = np.arange(width)
    row = np.where(steps <= 2 * band, 0, steps - 2 * band).astype(np.int64)  # free start within the band
    big = len(a) + len(b) + 1
    for i, c in enumerate(a):
        j = i + steps - band  # index in b of the byte matched on this diagonal
        valid = (j >= 0) & (j < len(y))
        cost = np.ones(width, np.int64)
        cost[valid] = y[j[valid]] != c
        diagonal = np.where(valid, row + cost, big)
        delete = np.concatenate((row[1:] + 1, [big]))
        best = np.minimum(diagonal, delete)
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > most:
            break
    return int(row.min())


def _regions(pos: np.ndarray, item: np.ndarray, offset: np.ndarray, index: GramIndex) -> list[tuple[int, int, int, int]]:
    """(item, diagonal, first, last offset) of the bands whose shared grams meet the bound."""
    found = []
    length = np.array([len(t) for t in index.texts])[item]
    window = np.minimum(length, LENGTH)
    edits = window * RATE // 100
    need = window - Q + 1 - Q * edits
    diagonal = pos - offset
    for shift in (0, 1):  # bands of width 2e, overlapping by e
        step = np.maximum(2 * edits, 1)
        band = (diagonal + shift * edits) // step
        # hits of bands with too few of them go before anything is sorted; bands that fall together in the table only keep more
        cell = (item * 40503 + band) & (_CELLS - 1)
        full = np.flatnonzero(np.bincount(cell, minlength=_CELLS)[cell] >= need)
        found += _dense(item[full], band[full], offset[full], need[full], window[full], diagonal[full])
    return found


def _dense(item, band, offset, need, window, diagonal) -> list[tuple[int, int, int, int]]:
    """Bands with ``need`` hits inside one window."""
    if not len(item):
        return []
    order = np.lexsort((offset, band, item))
    item, band, offset, need, window, diagonal = (x[order] for x in (item, band, offset, need, window, diagonal))
    start = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
    size = np.diff(np.concatenate((start, [len(item)])))
    group = np.repeat(np.arange(len(start)), size)
    # hit k and the hit need-1 places on: do they belong to one band and one window?
    k = np.arange(len(group))
    to = np.minimum(k + need - 1, len(group) - 1)
    ok = (k + need - 1 < len(group)) & (group[to] == group) & (offset[to] - offset <= window - Q)
    big = np.iinfo(np.int64).max
    first = np.minimum.reduceat(np.where(ok, offset, big), start)
    last = np.maximum.reduceat(np.where(ok, offset[to], -1), start)
    hit = np.flatnonzero(last >= 0)
    middle = start[hit] + size[hit] // 2
    return list(zip(item[start[hit]].tolist(), diagonal[middle].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True))


def _verify(text: bytes, pattern: bytes, diagonal: int, first: int, last: int, known: dict) -> int | None:
    """The edits of the first window of an item that is within its budget on a band, or None.

    The windows are those that can hold the band's hits, which may lie off both ends of the outermost ones by what the edits can destroy.
    """
    window = min(len(pattern), LENGTH)
    edits = edits_allowed(window)
    slack = Q * edits
    end = len(pattern) - window
    low = min(end, max(0, first - slack))
    top = max(low, min(end, last + Q - window + slack))
    likely = max(low, min(end, first))
    tried = sorted({*range(low - low % STEP, top + 1, STEP), *([end] if top + STEP > end else [])}, key=lambda at: abs(at - likely))
    for at in tried:
        piece = pattern[at : at + window]
        start = at + diagonal
        region = text[max(0, start - 2 * edits) : max(0, start + window + 2 * edits)]
        distance = known.get((piece, region))
        if distance is None:
            distance = 0 if piece in region else band_distance(piece, region, 4 * edits, edits)  # the match may begin and end anywhere in the region
            if len(known) < KNOWN:
                known[piece, region] = distance
        if distance <= edits:
            return distance
    return None


def leaks_in(text: bytes, index: GramIndex) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, edits) of the best verified region of each item in a normalised text: the fewest edits, then the first."""
    data = np.frombuffer(text, np.uint8)
    best: dict[int, tuple[int, int, int]] = {}
    known: dict[tuple[bytes, bytes], int] = {}  # repetitive texts show the same regions over and over
    for hits in index.hits(data):
        for item, diagonal, first, last in sorted(_regions(*hits, index), key=lambda r: r[1] + r[2]):
            if item in best and best[item][0] == 0:
                continue
            distance = _verify(text, index.texts[item], diagonal, first, last, known)
            if distance is not None and (item not in best or distance < best[item][0]):
                best[item] = (distance, max(0, first + diagonal), min(len(text), last + Q + diagonal))
    found = [(index.ids[item], start, end, edits) for item, (edits, start, end) in best.items()]
    if index.whole is not None:
        seen: dict[int, tuple[int, int, int, int]] = {}
        for end, (ids, size) in index.whole.iter(f" {text.decode('latin-1')} "):
            for i in ids:
                seen.setdefault(i, (i, end - 1 - size, end - 1, 0))
        found += seen.values()
    return sorted(found)


_LEAKS = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint"


def _search(documents: DataFrame, index: GramIndex) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_text(batch.column("text")).to_pylist(), strict=True):
                rows += [(doc_id, *x) for x in leaks_in(normalize(text), shared.value)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "start", "end", "edits"])

    return documents.select("doc_id", "text").mapInArrow(run, _LEAKS)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of about BLOCK_BYTES; the driver holds one block at a time. A longer item is a block of windows-overlapping pieces."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id IS NOT NULL").toLocalIterator():
        text = normalize(row["text"] or "")
        for at in range(0, max(1, len(text) - LENGTH), BLOCK_BYTES):
            piece = text[at : at + BLOCK_BYTES + LENGTH]
            if piece:
                block.append((row["item_id"], piece))
                size += len(piece)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the items that each document holds.

    ``start`` and ``end`` bound the matching stretch in bytes of the normalised
    text; ``edits`` is the distance of a window there, of several stretches the
    least, and of ties the first. An item of fewer than LEAST bytes is found
    only as it stands, between blanks, an empty one never. Null texts are empty; items without ``item_id`` are not looked for. Rows that
    share a ``doc_id``, and items that share an ``item_id``, give one row with
    the fewest edits. Other columns are ignored; if either table is empty, so
    is the result.
    """
    found = None
    for block in _blocks(benchmark):
        part = _search(docs, GramIndex.build(block))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], _LEAKS)
    best = F.min(F.struct("edits", "start", "end")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.start", "best.end", "best.edits")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the same columns.

    Each row is judged by its own text while it is read, so nothing is joined.
    """
    kept = docs
    for block in _blocks(benchmark):
        kept = _without(kept, GramIndex.build(block))
    return kept


def _without(docs: DataFrame, index: GramIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stay = [not leaks_in(normalize(t), shared.value) for t in as_text(batch.column("text")).to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
