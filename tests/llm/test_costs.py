"""Work and data of the corpus operators, where results alone do not show them."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import bpe, jaccard_join, lm_score
from tessera.llm.arrow_text import mix


def test_merging_looks_up_each_neighbour_once():
    import public_tokenizers

    class Counted(dict):
        n = 0

        def get(self, *args):
            Counted.n += 1
            return super().get(*args)

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = bpe.BpeModel(f.read())
    model.rank = Counted(model.rank)
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choices("etaoinshrdlu", k=40))
        before = Counted.n
        merged = model.merge(model.symbols(word, True))
        assert Counted.n - before <= 3 * len(word)
        assert merged == model._merge_long(model.symbols(word, True))


def test_packed_pairs_take_few_bytes_and_come_back():
    rng = np.random.default_rng(2)
    words = mix(np.arange(1, 5001).astype(np.uint64))
    at = rng.zipf(1.3, 60_000) % 5000
    second, first, doc = words[at], words[np.roll(at, 1)], np.sort(mix(rng.integers(0, 400, 60_000).astype(np.uint64)).view(np.int64))
    packed = lm_score._packed_rows(np.zeros(len(doc), np.int64), doc, 1, second, first)
    assert packed.nbytes < 200_000  # 321,284 without differences, byte planes and compression
    found = zip(*lm_score._unpacked(iter([packed]), 2), strict=True)
    assert sorted(found) == sorted(zip(doc, second, first, strict=True))


def test_packed_features_take_as_many_bytes_in_many_buckets():
    rng = np.random.default_rng(4)
    ids = np.arange(7_000_000, 7_001_000) * 3
    sets = [np.sort(mix(rng.choice(10**7, 300, False).astype(np.uint64))) for _ in ids]
    starts, values = np.arange(len(ids) + 1) * 300, np.concatenate(sets)
    packed = {b: list(jaccard_join._pack(iter([(ids, starts, values)]), b)) for b in (64, 640)}
    size = {b: sum(x.nbytes for x in batches) for b, batches in packed.items()}
    assert size[640] < 1.25 * size[64]  # 2.05 times with the ids and counts of documents in every row
    for b, batches in packed.items():
        counted = list(jaccard_join._count_shared(b)(iter(batches)))
        out = pa.Table.from_batches(jaccard_join._sum_counts(iter(counted))).to_pydict()
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        want = (times[at] > 1).reshape(len(ids), 300).sum(1)
        assert out["doc_id"] == ids.tolist() and out["shared"] == want.tolist() and out["n"] == [300] * len(ids)
