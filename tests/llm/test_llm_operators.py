"""Each corpus operator against a plain version, on small hard tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plain_versions import edit_distance
from tessera.llm import bpe, chat, decontaminate, jaccard_join, licenses, line_dedup, lm_score, pii, quality, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def near(text, every):
    words = text.split()
    return " ".join("zzz" if i % every == every - 1 else w for i, w in enumerate(words))


@pytest.fixture(scope="module")
def texts():
    a, b = prose(1, 120), prose(2, 90)
    passage = prose(3, 60)
    return {
        0: a, 1: a, 2: near(a, 100), 3: near(a, 30), 4: None, 5: "", 6: "   \n\t ", 7: "one two three", 8: "One TWO three", 9: b + " " + passage, 10: passage + " " + prose(4, 80),
        11: "x" * 700, 12: prose(5, 30) + "\n" + prose(6, 12) + "\n\n" + prose(6, 12), 13: "héllo wörld ünd so wéiter " * 20, 14: near(near(a, 100), 97), 15: prose(7, 6000),
        16: prose(6, 12) + "\n" + prose(8, 20), 17: "a b c d e", 18: "a b c d e f",
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "src0", None, "clash") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_groups(docs, texts, empty):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(docs.union(docs.where("doc_id = 2"))).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in sets}
    assert jaccard_join.similar_groups(empty).count() == 0


def test_partenum_shares_a_signature():
    r = np.random.default_rng(5)
    for _ in range(400):
        n = int(r.integers(3, 400))
        base = r.integers(0, 2**63, n).astype(np.uint64)
        drop, add = int(r.integers(0, n // 7 + 1)), int(r.integers(0, n // 7 + 1))
        other = np.concatenate([base[drop:], r.integers(0, 2**63, add).astype(np.uint64)])
        both = len(np.intersect1d(base, other))
        if 100 * both >= 75 * (len(base) + len(other) - both):
            shared = np.intersect1d(base, other)
            a, b = (jaccard_join.signatures(x, m) for x, m in ((shared, len(base)), (other, len(other))))
            assert len(np.intersect1d(a, b)), (n, drop, add)


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    """A group of copies that only its original links, with every signature treated as a large one."""
    original = prose(11, 150)
    texts = [original] + [near_at(original, k) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(docs).collect()}
    monkeypatch.setattr(jaccard_join, "FEW", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK_FEATURES", 500)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(docs).collect()} == want
    assert set(want.values()) == {0}


def near_at(text, k):
    words = text.split()
    words[3 * k % len(words)] = f"edit{k}"
    words[(3 * k + 60) % len(words)] = f"other{k}"
    return " ".join(words)


def test_quality_measures(docs, texts, empty):
    judged = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t in texts.items():
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        times, cover = Counter(runs), set()
        for k, x in enumerate(runs):
            if times[x] > 1:
                cover.update(range(k, k + 8))
        r = judged[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(cover) > 30 * len(words))
    assert quality.quality(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in judged.items() if r["kept"]}


def test_quality_sketch_is_mergeable(spark):
    b = [(r["v"], r["b"], r["f"]) for r in spark.range(5000).select(F.col("id").alias("v"), quality.bucket(F.col("id")).alias("b")).withColumn("f", quality.bucket_floor(F.col("b"))).collect()]
    assert all(f <= v and v - f <= v / 16 + 1 for v, _, f in b) and [x[1] for x in b] == sorted(x[1] for x in b)


def test_simhash_and_lines(spark, docs, texts, empty):
    cut = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert cut[0]["n_removed"] == 0 and cut[1]["n_removed"] == 1 and cut[1]["text"] == ""
    assert cut[12]["n_removed"] == 1 and cut[16]["n_removed"] == 1 and cut[16]["text"] == texts[16].split("\n")[1]
    assert cut[4]["text"] is None and cut[7]["n_removed"] == cut[8]["n_removed"] == 0
    assert line_dedup.dedup_lines(empty).count() == 0 and set(docs.columns) <= set(line_dedup.dedup_lines(docs).columns)


def test_block_sums_and_simhash(spark):
    """Sums, bits and keys against plain arithmetic over the same word hashes."""
    import xxhash

    texts = {1: prose(61, 7), 2: prose(62, 30), 3: prose(63, 70), 4: prose(64, 400), 5: "aaaa " * 9000, 6: "a b c d"}
    rows = line_dedup.signed_lines(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    sums = F.array(*line_dedup._SUMS)
    got = rows.withColumn("sim", line_dedup.simhash(sums)).withColumn("keys", line_dedup.block_keys(sums, F.col("level"))).collect()
    assert {r["doc_id"] for r in got if r["main"]} == set(texts) and [r["n"] for r in got if r["doc_id"] == 6] == [None]
    for r in got:
        words = texts[r["doc_id"]].split()
        if len(words) < line_dedup.LEAST_WORDS:
            continue
        level = lambda n: max(0, (n // 3).bit_length() - 3)
        assert r["main"] == (r["level"] == level(len(words))) and r["level"] in (level(len(words)), level(int(len(words) * 0.9 + 1e-9)))
        blocks = 5 if r["level"] == 0 else 8 if r["level"] == 1 else 2 << r["level"]
        own = {}
        for w in words:
            if len(w) >= line_dedup.LEAST_LETTERS:
                h = xxhash.xxh64_intdigest(w.encode(), seed=42)
                own.setdefault(((h >> 47 & 0xFFFF) * blocks) >> 16, []).append(h)
        sim = 0
        for j in range(line_dedup.BLOCKS):
            lanes = [sum(h >> (10 * i) & 127 for h in own.get(j, ())) for i in range(line_dedup.BITS)]
            count = len(own.get(j, ()))
            want = sum(x << (10 * i) for i, x in enumerate(lanes)) + (count << 50)
            assert r[f"s{j}"] == (want if want < 1 << 63 else -1)
            if count <= 8:
                bits = [r["sim"] >> (10 * i + 7 - j) & 1 for i in range(line_dedup.BITS)]
                assert bits == [int(x >= 64 * count) for x in lanes]
        assert len(r["keys"]) <= 10 and len(set(r["keys"])) == len(r["keys"])


def test_near_lines_are_linked(spark):
    line = prose(21, 120)
    rows = [(1, line + "\n" + prose(22, 30)), (2, "short\n" + line[:-1] + "q"), (3, prose(23, 60))]
    cut = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert cut == {1: 0, 2: 1, 3: 0}


def test_recall_of_near_lines(spark):
    """Pairs within the edit budget that meet on a block and pass the radius, by words of a line and kind of edit; the edit distance decides which pairs count."""
    r, rows = random.Random(51), []
    for n in (5, 10, 20, 30, 50):
        for k in range(100):
            words = prose(r.random(), n).split()
            line, at = " ".join(words), r.randrange(n)
            typo = " ".join([*words[:at], "q" + words[at][1:], *words[at + 1 :]])
            swap = " ".join([*words[:at], "z" * len(words[at]), *words[at + 1 :]])
            few = " ".join("z" * len(w) if r.random() < 0.05 else w for w in words)
            edited = list(line)
            for i in r.sample([i for i, c in enumerate(line) if c != " "], len(line) // 10):
                edited[i] = "q"
            rows += [(n, "typo", line, typo), (n, "word", line, swap), (n, "twentieth", line, few), (n, "all", line, "".join(edited))]
    docs = spark.createDataFrame([(2 * i + side, row[2 + side]) for i, row in enumerate(rows) for side in (0, 1)], "doc_id bigint, text string")
    sums = F.array(*line_dedup._SUMS)
    signed = line_dedup.signed_lines(docs).select("doc_id", "level", line_dedup.simhash(sums).alias("sim"), line_dedup.block_keys(sums, F.col("level")).alias("keys"))
    by_doc = {}
    for x in signed.collect():
        by_doc.setdefault(x["doc_id"], []).append(x)
    hits = {}
    for i, (n, kind, a, b) in enumerate(rows):
        budget = max(len(a), len(b)) * line_dedup.EDITS // 100
        if a != b and edit_distance(a, b, budget) <= budget:
            met = any(x["level"] == y["level"] and set(x["keys"]) & set(y["keys"]) and (x["sim"] ^ y["sim"]).bit_count() <= line_dedup.RADIUS for x in by_doc[2 * i] for y in by_doc[2 * i + 1])
            hits.setdefault((n, kind), []).append(met)
    recall = {k: sum(v) / len(v) for k, v in hits.items()}
    print("recall", sorted(recall.items()))
    assert all(x >= 0.9 for (n, kind), x in recall.items() if kind != "all" and n >= 10)


def test_one_changed_word_is_linked(spark):
    words = prose(52, 12).split()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:5], words[5][0] + "q" + words[5][1:], *words[6:]]))]
    cut = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert cut == {1: 0, 2: 1}


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "Read more\n\n东京是日本的首都。\n---"), (2, "  Read more\r\n\nread more\n---"), (3, "东京是日本的首都。\nmenu\nmenu")]
    cut = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert cut == {1: (rows[0][1], 0), 2: ("\nread more\n---", 1), 3: ("menu", 2)}


def test_decontamination(spark, empty):
    item = prose(31, 60)
    edited = item[:40] + item[42:100] + "qq" + item[100:]
    docs = spark.createDataFrame([(1, prose(32, 50) + " " + item + " " + prose(33, 50)), (2, prose(34, 200)), (3, edited.upper()), (4, None), (5, ""), (6, prose(35, 40) + item[60:160])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, prose(36, 60)), (9, None), (10, "tiny")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(1, 7), (3, 7), (6, 7)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {2, 4, 5}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(empty, bench).count() == 0


def test_band_distance_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(60):
        a = bytes(r.choices(b"abc", k=30))
        b = bytearray(a)
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice(b"abc")
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontaminate.band_distance(a, bytes(b), 8, 99) == min(row)


def test_pii(spark, empty):
    rows = [
        (1, "mail a.b@c.example.org or +1 (310) 555-4510, ip 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111."),
        (2, "write to jane [at] site (dot) org or call plus one three one zero five five five four five one zero"),
        (3, "jоhn@exаmple.com and 192[.]168[.]1[.]9"), (4, None), (5, "look at this, a dot on the wall"),
    ]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    text = rows[0][1]
    spans = [("email", "a.b@c.example.org"), ("phone", "+1 (310) 555-4510"), ("ip", "10.0.0.25,"), ("card", "4111 1111 1111 1111")]
    want = ",".join(f"{k}:{text.index(s)}:{text.index(s) + len(s.rstrip(','))}" for k, s in spans)
    assert got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 1, 1)
    for i, parts in ((2, ["jane [at] site (dot) org", "plus one three one zero five five five four five one zero"]), (3, ["jоhn@exаmple.com", "192[.]168[.]1[.]9"])):
        t = rows[i - 1][1]
        assert [t[int(s) : int(e)] for _, s, e in (x.split(":") for x in got[i]["spans"].split(","))] == parts
    assert got[4]["spans"] == got[5]["spans"] == "" and pii.find(empty).count() == 0


def test_licenses(spark, empty):
    rows = [
        (1, "Released under the MIT License. mit LICENSE"), (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Permission is hereby granted, free of charge, to a person"), (4, None), (5, "CC-BY 4.0 and the MIT licensed"), (6, "SPDX-License-Identifier: BSD-3-Clause"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 3, 5, "mit")
    assert got[2]["labels"] == "gpl,gpl-notice" and 0.9 < got[2]["score"] <= 1
    assert got[3]["labels"] == "" and got[4]["n_words"] == 0 and got[4]["first_word"] is None
    assert got[5]["base_labels"] == "cc-by" and got[6]["labels"] == "spdx" and licenses.scan(empty).count() == 0
    a = licenses.Automaton.compile("x", "a [[b c]] {{2}} d")
    for words, end in (("a d", 2), ("a b c d", 4), ("a b d", 3), ("a q r d", 4), ("a q r s d", -1), ("b d", -1)):
        assert a.match([w.encode() for w in words.split()], 0) == end


def test_bpe_equals_the_library(spark, docs, texts, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoded = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(encoded[i]["ids"]) == ids and encoded[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    model = bpe.BpeModel(open(path, encoding="utf-8").read())
    r = random.Random(1)
    hard = ["a<|endoftext|>b", "don't WE'RE Σίσυφος ΟΔΟΣ é ﬁ \x1c\x85 1２3 日本 🎉!!"] + ["".join(r.choices("abcdefghijklmnoprstuvwyz'1 .é", k=40)) for _ in range(2000)]
    hard += ["".join(r.choices("abcdehinorst", k=k)) for k in (47, 48, 49, 50, 500, 20000)] + ["ab" * 3000, "a" * 5000]
    assert [x.tolist() for x in model.encode(hard)] == [e.ids for e in library.encode_batch(hard, add_special_tokens=False)]
    assert bpe.digests(empty, path).count() == 0


def test_suffix_dedup(spark, docs, texts, empty):
    r = random.Random(9)
    more = {100 + i: "".join(r.choices("ab", k=2500)) + texts[15][1000 * i : 1000 * i + 300] for i in range(4)}
    more |= {110: "ab" * 300, 111: more[100][50:251] + "é" * 150, 112: more[101][:199], 113: more[102]}
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(more.items()), "doc_id bigint, text string"))
    for limit in (4096, 1):
        suffix_dedup.SORTED, old = limit, suffix_dedup.SORTED
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(rows).collect()}
        suffix_dedup.SORTED = old
        data = {i: (t or "").encode() for i, t in (texts | more).items()}
        seen = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
        for i, b in data.items():
            gone = [False] * len(b)
            for k in range(len(b) - 199):
                if seen[b[k : k + 200]] > 1:
                    gone[k : k + 200] = [True] * 200
            runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), sum(gone), runs), i
            assert (b if got[i]["kept"] is None else bytes(got[i]["kept"])) == bytes(c for c, g in zip(b, gone, strict=True) if not g)
    twice = spark.createDataFrame([(1, texts[15])] * 2, "doc_id bigint, text string")
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(twice).collect()] == [len(texts[15])] * 2
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_pieces(monkeypatch):
    """A long document parsed in pieces has the same triggers as in one."""
    text = prose(41, 4000).encode()
    whole = {(int(p), int(t), int(c)) for x in suffix_dedup._parse(np.array([1]), [text]) for p, t, c in zip(*x[1:], strict=True)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    pieces = {(int(p), int(t), int(c)) for x in suffix_dedup._parse(np.array([1]), [text]) for p, t, c in zip(*x[1:], strict=True)}
    assert pieces == whole


def test_suffix_pieces_give_each_trigger_once(monkeypatch):
    text = prose(41, 4000).encode()
    rows = lambda: sorted((int(p), int(t), int(c)) for x in suffix_dedup._parse(np.array([1]), [text]) for p, t, c in zip(*x[1:], strict=True))
    whole = rows()
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    assert rows() == whole


def test_suffix_dedup_of_several_pieces(spark):
    """Text around the cuts between pieces stays if it occurs once, and goes if it does not."""
    long = prose(43, 440_000).encode()
    cut = suffix_dedup.PIECE
    assert len(long) > 2 * cut
    data = {1: long, 2: prose(44, 60).encode() + long[cut - 150 : cut + 350] + prose(45, 60).encode(), 3: prose(46, 200).encode()}
    seen = Counter(hash(b[k : k + 200]) for b in data.values() for k in range(len(b) - 199))
    rows = spark.createDataFrame([(i, b.decode()) for i, b in data.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(rows).collect()}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (got[i]["n_removed"], got[i]["n_spans"]) == (int(gone.sum()), runs), i
        assert (b if got[i]["kept"] is None else bytes(got[i]["kept"])) == np.frombuffer(b, np.uint8)[~gone].tobytes()


def test_lm_scores(docs, texts, empty):
    import math

    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t in texts.items()}
    unigrams = Counter(w for ws in words.values() for w in ws)
    pairs = Counter(p for ws in words.values() for p in zip(ws, ws[1:], strict=False))
    total = sum(unigrams.values())
    got = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    for i, ws in words.items():
        s = 0.0
        for k, w in enumerate(ws):
            p = (ws[k - 1], w) if k else None
            s += math.log(pairs[p] / unigrams[p[0]]) if p and pairs[p] > 1 else math.log(unigrams[w] / total) + (math.log(0.4) if p else 0)
        assert got[i]["n_words"] == len(ws) and abs(got[i]["score"] - s) < 1e-6 * max(1, -s)
    assert lm_score.score(empty).count() == 0


def test_chat(spark):
    r = random.Random(4)
    parts = ["\\", "<|", "|>", "</turn>", "\n", "a", "é", "<", "|", ">", "/turn>", "### Assistant: "]
    turns = [(c, t, r.choice(["user", "assistant", "x|y"]), "".join(r.choices(parts, k=r.randint(0, 9)))) for c in range(60) for t in range(r.randint(1, 6))]
    rows = turns + [(100, None, None, None), (None, 1, "user", "lost"), (100, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("extra", F.lit(1)).repartition(5)
    got = {x["conv_id"]: x for x in chat.format_conversations(df).collect()}
    assert set(got) == {*range(60), 100}
    for c in range(60):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        data = bytes(got[c]["formatted"])
        assert chat.parse(data) == [(x[2], x[3]) for x in own]
        assert [chat.unescape(data[a:b].decode()) for a, b in got[c]["trained"]] == [x[3] for x in own if x[2] == "assistant"]
    assert chat.parse(bytes(got[100]["formatted"])) == [("", ""), ("assistant", "z")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_conversation_over_batches(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("ab"), 3000).alias("text"))
    rows = chat.read_back(chat.format_conversations(df)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in rows] == [(1, 3000)]


def test_sliced_arrow_text_is_read_right():
    from tessera.llm.arrow_text import as_text, words_of

    batch = pa.record_batch([pa.array(["One two", "THREE", None, "four  Five"])], names=["text"]).slice(1, 3)
    words = words_of(as_text(batch.column("text")), lower=True)
    assert [words.vocabulary[i].as_py() for i in words.ids] == ["three", "four", "five"] and words.counts.tolist() == [1, 0, 2]
