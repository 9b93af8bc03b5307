"""Byte-pair encoding by speculation and verification.

Merging pairs one at a time is the slow part of BPE. Here each distinct word of
a batch is first cut greedily into the longest vocabulary entries. A sequence
of tokens is the BPE encoding of its text exactly if every adjacent pair of
tokens is the encoding of its own text, so the proposals of all words are
tested at once: their adjacent pairs are looked up in a sorted table of known
verdicts, and only pairs never seen before are decided by merging. Words with
an incompatible pair are merged exactly.

The model is a tokenizer file (JSON, BPE with an end-of-word suffix over a
byte alphabet); its text is broadcast, as its size is that of the vocabulary
and not of the data.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.arrow_text import as_text, slices

#: Words whose encoding a worker remembers; the table is emptied when full.
WORD_CACHE = 200_000
#: Pairs whose verdicts a worker remembers; the table begins anew when full.
PAIR_TABLE = 1_000_000
#: Symbols from which a word is merged by way of a heap.
LONG_WORD = 48
_ASIDE = {"n_tokens", "ids"}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class BpeModel:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(chain(self.vocab.values(), self.special.values()))
        self.tokens = [""] * size
        for token, i in chain(self.vocab.items(), self.special.items()):
            self.tokens[i] = token
        self.numbers = [str(i) for i in range(size)]
        self.longest = max(map(len, self.vocab))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # code points that this regex module counts as letters, but that its Unicode tables' older versions do not have
        assigned = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
        self.newer = frozenset(c for c in assigned if unicodedata.category(c) == "Cn")
        self.unassigned = dict.fromkeys(map(ord, self.newer), "\u0378")
        self.byte_map = {chr(b): c for b, c in byte_alphabet().items()}
        self.table = str.maketrans(self.byte_map)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pairs = np.zeros(0, np.int64)
        self.verdicts = np.zeros(0, bool)

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact BPE of a list of symbols: the lowest-ranked pair first, the leftmost of equals."""
        if len(symbols) > LONG_WORD:
            return self._merge_long(symbols)
        rank, none = self.rank.get, 1 << 30
        # a merge changes the ranks of its two neighbours only
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            merged = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [merged]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], merged), none)
            if at < len(ranks):
                ranks[at] = rank((merged, symbols[at + 1]), none)
        return symbols

    def _merge_long(self, symbols: list) -> list[str]:
        """The same over a linked list and a heap of (rank, place), so that a long word costs little more than its length."""
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            best, k = heapq.heappop(heap)
            j = after[k]
            if symbols[k] is None or j >= n or rank.get((symbols[k], symbols[j])) != best:
                continue  # one of the two has been merged since
            symbols[k], symbols[j], after[k] = symbols[k] + symbols[j], None, after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (pair := (symbols[left], symbols[after[left]])) in rank:
                    heapq.heappush(heap, (rank[pair], left))
        return [s for s in symbols if s is not None]

    def symbols(self, text: str, final: bool) -> list[str]:
        letters = list(text)
        if final and letters:
            letters[-1] += self.suffix
        return letters

    def exact(self, word: str) -> tuple[int, ...]:
        return tuple(self.vocab[s] for s in self.merge(self.symbols(word, True)))

    def greedy(self, word: str) -> list[int]:
        """Longest vocabulary entries from the left; the last one carries the suffix."""
        vocab, found, at, n = self.vocab, [], 0, len(word)
        while at < n:
            token = vocab.get(word[at:] + self.suffix) if n - at <= self.longest else None
            end = n
            if token is None:
                end = min(n - 1, at + self.longest) if self.suffix else min(n, at + self.longest)
                while end > at + 1 and word[at:end] not in vocab:
                    end -= 1
                if end <= at:
                    return []
                token = vocab.get(word[at:end])
                if token is None:
                    return []
            found.append(token)
            at = end
        return found

    def compatible(self, pair: int) -> bool:
        """Whether two tokens (or one, coded with itself as -1) are the encoding of their text."""
        left, right = divmod(pair, 1 << 20)
        tokens = [self.tokens[left - 1]] * (left > 0) + [self.tokens[right]]
        last = tokens[-1]
        final = bool(self.suffix) and last.endswith(self.suffix)
        text = "".join(tokens[:-1]) + (last[: -len(self.suffix)] if final else last)
        return self.merge(self.symbols(text, final)) == tokens

    def check(self, pairs: np.ndarray) -> np.ndarray:
        """The verdict on each pair code; new codes are decided once and remembered."""
        new = np.setdiff1d(pairs, self.pairs)
        if len(new):
            if len(self.pairs) + len(new) > PAIR_TABLE:
                self.pairs, self.verdicts, new = self.pairs[:0], self.verdicts[:0], np.unique(pairs)
            at = np.searchsorted(self.pairs, new)
            verdicts = np.fromiter((self.compatible(int(p)) for p in new), bool, len(new))
            self.pairs, self.verdicts = np.insert(self.pairs, at, new), np.insert(self.verdicts, at, verdicts)
        return self.verdicts[np.searchsorted(self.pairs, pairs)]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered: propose, verify all, merge what failed."""
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in words]
        proposed = [self.greedy(m) for m in mapped]
        lengths = np.array([len(p) for p in proposed])
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        before = np.zeros(len(flat), np.int64)  # 0: the first token of its word
        if len(flat):
            inner = owner[1:] == owner[:-1]
            before[1:][inner] = flat[:-1][inner] + 1
        single = lengths[owner] == 1
        tested = (before > 0) | single  # a lone token must be its own encoding
        good = np.ones(len(words), bool)
        bad = ~self.check((before[tested] << 20) | flat[tested])
        good[owner[tested][bad]] = False
        good[lengths == 0] = False
        for k, word in enumerate(words):
            self.cache[word] = tuple(proposed[k]) if good[k] else self.exact(mapped[k])

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lowering is by character: no final sigma
        text = text.lower()
        if not text.isascii() and not self.newer.isdisjoint(text):
            shadow = text.translate(self.unassigned)
            return [text[m.start() : m.end()] for m in self.words.finditer(shadow)]
        return self.words.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [self.specials.split(t) if self.specials and "<" in t else [t] for t in texts]
        words = [[self.pieces(p) if k % 2 == 0 else p for k, p in enumerate(ps)] for ps in parts]
        if len(self.cache) > WORD_CACHE:
            self.cache.clear()
        fresh = set(chain.from_iterable(w for ws in words for w in ws if isinstance(w, list))) - self.cache.keys()
        if fresh:
            self.learn(list(fresh))
        find = self.cache.__getitem__
        out = []
        for ws in words:
            ids = chain.from_iterable(chain.from_iterable(map(find, w)) if isinstance(w, list) else (self.special[w],) for w in ws)
            out.append(np.fromiter(ids, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids, joined by blanks; the model has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def written(self, ids: np.ndarray) -> str:
        return " ".join(map(self.numbers.__getitem__, ids.tolist()))


_loaded: dict[str, BpeModel] = {}


def _model(source: str) -> BpeModel:
    """The model of a tokenizer file's text, built once in each worker."""
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = BpeModel(source)
    return _loaded[key]


def _mapped(df: DataFrame, path: str, column: str, schema: T.StructType, each) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(source.value)
        for batch in slices(batches, column) if column == "text" else batches:
            yield each(model, batch)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``n_tokens`` (long) and ``ids`` (array of int) of its ``text``.

    ``path`` is a tokenizer file on the driver. Special tokens in a text count
    as such, as the file says. A null or blank text has no ids. Columns named
    ``n_tokens`` or ``ids`` are replaced; every row is encoded by itself.
    """
    kept = [f for f in docs.schema.fields if f.name not in _ASIDE]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def each(model: BpeModel, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = model.encode(as_text(batch.column("text")).to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(np.diff(ends).astype(np.int64)), lists], names=schema.names)

    return _mapped(docs.select(*[f.name for f in kept]), path, "text", schema, each)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; null ids give the empty text."""
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.StringType())])

    def each(model: BpeModel, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [model.decode(np.asarray(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.names)

    return _mapped(encoded.select(*[f.name for f in kept]), path, "ids", schema, each)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without passing ids between processes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def each(model: BpeModel, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = model.encode(as_text(batch.column("text")).to_pylist())
        columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(model.written(x)) for x in ids]), pa.array([sha(model.decode(x)) for x in ids])]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _mapped(docs.select("doc_id", "text"), path, "text", schema, each)
