"""Words of Arrow text columns as flat numpy arrays.

The functions run inside Spark tasks on one Arrow batch at a time; ``slices``
bounds how much text is expanded at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes expanded at once in a task.
SLICE_BYTES = 6 << 20


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one non-null large_string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    text = pc.fill_null(column.cast(pa.large_string()), "")
    # a copy: string kernels misread arrays whose first offset is not 0, as slices have
    return text.take(pa.array(np.arange(len(text))))


def byte_lengths(text: pa.Array) -> np.ndarray:
    return pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece has about ``limit`` bytes (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(as_text(batch.column(column))))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words of a batch in order: ids into ``vocabulary``, and where each document's words start."""

    ids: np.ndarray
    vocabulary: pa.Array
    starts: np.ndarray  # len = documents + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def documents(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each vocabulary entry."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in self.vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.vocabulary))


def split_pieces(parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The non-empty pieces of a list<string> array, and each list's start among them."""
    flat = parts.flatten()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    kept = np.concatenate(([0], np.cumsum(keep)))
    offsets = parts.offsets.to_numpy()
    return flat.filter(pa.array(keep)), kept[offsets - offsets[0]]


def words_of(text: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of anything but space and \\x09-\\x0D; ``lower`` maps A-Z first."""
    if lower:
        text = pc.ascii_lower(text)
    pieces, starts = split_pieces(pc.ascii_split_whitespace(text))
    encoded = pieces.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, starts.astype(np.int64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of each value over all of it."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Odd multiplier for hashing sequences.
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``size`` words; a shorter document is one run by itself."""
    h = words.hashes()[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    n = len(h)
    counts = words.counts
    docs = words.documents()
    windows = max(0, n - size + 1)
    acc = np.zeros(windows, np.uint64)
    for j in range(size):
        acc = acc * ODD + h[j : j + windows]
    inside = docs[:windows] == docs[size - 1 : size - 1 + windows] if windows else np.zeros(0, bool)
    own, value = docs[:windows][inside], mix(acc[inside])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            acc1 = 0
            for x in h[words.starts[d] : words.starts[d + 1]].tolist():
                acc1 = (acc1 * int(ODD) + x) & 0xFFFFFFFFFFFFFFFF
            extra[k] = (acc1 + int(counts[d])) & 0xFFFFFFFFFFFFFFFF
        own, value = np.concatenate([own, short]), np.concatenate([value, mix(extra ^ ODD)])
    return own, value


def distinct_per_document(own: np.ndarray, value: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document: (starts of documents, values)."""
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    own, value = own[first], value[first]
    starts = np.searchsorted(own, np.arange(documents + 1))
    return starts, value
