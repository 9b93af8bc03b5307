"""Corpus operators against plain versions on planted tables, and on long, empty, repeated and clashing rows."""

import hashlib
import random
import re
import time

import pytest
from plain_versions import dedup_lines, measures, similar_groups, stretch_distance, verdicts
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, chat, decontaminate, jaccard_join, licenses, line_dedup, lm_score, pii, quality, suffix_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


def changed(text, seed, share):
    r = random.Random(seed)
    return " ".join("q" * len(w) if r.random() < share else w for w in text.split(" "))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in texts.items()], DOCS)


LONG = {1: "7" * 1_000_000, 2: "a@" + "b" * 1_000_000, 3: "ha " * 340_000, 4: "<|" * 500_000, 5: " " * 1_000_000, 6: "0" * 5000 + ".1.1.1", 7: "+1" + " " * 500_000, 8: "one " * 250_000, 9: "mit license " * 80_000}


@pytest.fixture(scope="module")
def long_docs(spark):
    """A megabyte of digits, letters, one word, control strings and blanks each, a row without an id, and one twice."""
    rows = [(i, t, None, None, 1, "x", 2.0) for i, t in LONG.items()] + [(None, "nobody", None, None, None, None, None)] * 2
    return spark.createDataFrame(rows, f"{DOCS}, n_words string, score double").repartition(4).cache()


@pytest.mark.parametrize(
    "run",
    [
        lambda d: pii.find(d), lambda d: licenses.scan(d), lambda d: quality.quality(d), lambda d: line_dedup.dedup_lines(d), lambda d: jaccard_join.similar_groups(d),
        lambda d: lm_score.score(d), lambda d: suffix_dedup.remove_repeats(d),
        lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([(1, "ha " * 100), (2, "hb ha " * 50), (3, prose(1, 40))], "item_id bigint, text string")),
    ],
    ids=["pii", "licenses", "quality", "line_dedup", "jaccard", "lm_score", "suffix_dedup", "decontaminate"],
)
def test_long_texts_end_soon(long_docs, run):
    began = time.time()
    rows = run(long_docs).collect()
    assert time.time() - began < 100
    if "item_id" in rows[0]:
        assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(3, 1)}


def test_long_texts_in_bpe(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    began = time.time()
    texts = {i: t[:200_000] for i, t in LONG.items()}
    rows = bpe.digests(table(spark, texts), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == len(texts) and time.time() - began < 100


def test_bpe_pair_table_is_bounded(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    model = bpe.BpeModel(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = [prose(k, 300) for k in range(8)]
    want = [x.tolist() for x in model.encode(texts)]
    monkeypatch.setattr(bpe, "PAIR_TABLE", 500)
    model.cache.clear()
    got = []
    for t in texts:
        got += [x.tolist() for x in model.encode([t])]
        model.cache.clear()
        assert len(model.pairs) == len(model.verdicts) <= 3000  # the limit, or the pairs of one batch
    assert got == want


def test_pii_base_is_the_contract(spark):
    """Counts and digests against the plain patterns, on texts made of their pieces."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "1", "22", "255", "10.0.0.1", "4111111111111111", "+", "+1 ", "(310)", " ", "555", "é", "%", ".."]
    texts = {i: "".join(r.choices(parts, k=r.randint(0, 30))) for i in range(1500)}

    def good(kind, m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    got = {x["doc_id"]: x for x in pii.find(table(spark, texts)).collect()}
    for i, t in texts.items():
        spans = sorted((m.start(), k, m.end()) for k, kind in enumerate(patterns) for m in re.finditer(patterns[kind], t) if good(kind, m.group()))
        text = ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [got[i][f"n_{kind}"] for kind in patterns] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_license_base_and_templates(spark):
    r = random.Random(3)
    pieces = ["MIT", "License", "apache", "LICENSE", "cc", "by", "gnu", "general", "public", "-", "x"]
    texts = {i: " ".join(r.choices(pieces, k=r.randint(0, 40))) for i in range(400)}
    got = {x["doc_id"]: x for x in licenses.scan(table(spark, texts)).collect()}
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        base = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["base_labels"]) == (len(words), len(base), ",".join(sorted({b for _, b in base})))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(got[i]["base_labels"].split(",")) <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1


MIT = """The MIT License. Copyright (c) 2031 Jane Doe and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice {extra} shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE {holder} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_license_texts(spark):
    """Optional and replaceable regions may vary, mandatory wording may not."""
    good = MIT.format(extra="(including the next paragraph)", holder="AUTHORS OR COPYRIGHT HOLDERS")
    texts = {1: good, 2: MIT.format(extra="", holder="FOUNDATION"), 3: good.replace("free of charge", "for a fee"), 4: good.replace("BE LIABLE", "ever BE LIABLE"), 5: "x " + good.upper() + " y"}
    labels = {x["doc_id"]: set(x["labels"].split(",")) for x in licenses.scan(table(spark, texts)).collect()}
    assert {i for i, found in labels.items() if "mit-full" in found} == {1, 2, 4, 5}
    assert "mit-full" not in labels[3]


def test_leaks_against_all_windows(spark):
    """Every document with a window of an item within the budget is found, unless all its matches are shorter than a window and a step; nothing else is."""
    r = random.Random(5)
    items = {10: prose(1, 30), 11: prose(2, 14), 12: "only a short one", 13: prose(3, 8)[:40], 14: "only a short one"}
    texts = {}
    for i in range(40):
        item = items[r.choice([10, 11, 13])]
        a = r.randrange(max(1, len(item) - 80))
        part = list(item[a : a + r.randint(80, 200)])
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(part))
            part[k : k + 1] = r.choice([[], ["z"], [part[k], "z"]])
        texts[i] = prose(100 + i, 25) + " " + "".join(part) + " " + prose(200 + i, 25)
    texts |= {50: "it is Only a  SHORT one, yes", 51: "lonely a short one", 52: "", 53: None}
    found = {}
    for x in decontaminate.leaks(table(spark, texts), spark.createDataFrame(list(items.items()), "item_id bigint, text string")).collect():
        found.setdefault(x["doc_id"], {})[x["item_id"]] = x
    for i, t in texts.items():
        text = decontaminate.normalize(t or "")
        for k, item in items.items():
            pattern = decontaminate.normalize(item)
            if len(pattern) < decontaminate.LEAST:
                assert (k in found.get(i, {})) == (f" {pattern.decode()} " in f" {text.decode()} "), (i, k)
                continue
            size = min(len(pattern), decontaminate.LENGTH)
            budget = decontaminate.edits_allowed(size)
            starts = sorted({*range(0, len(pattern) - size + 1, decontaminate.STEP), len(pattern) - size})
            best = min(stretch_distance(pattern[s : s + size], text) for s in starts)
            assert (k in found.get(i, {})) == (best <= budget), (i, k, best)


def test_decontamination_of_odd_rows(spark):
    item = prose(31, 60)
    rows = [(1, item, "a"), (1, item, "b"), (None, item, "c"), (2, "  ", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "")], "item_id bigint, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"], r["edits"]) for r in decontaminate.leaks(docs, bench).collect()) == [(-1, 7, 0), (1, 7, 0)]
    assert [r["item_id"] for r in decontaminate.clean(docs, bench).collect()] == ["d"]


@pytest.fixture(scope="module")
def families():
    """Families of near lines, some only linked by a line in the middle, among other lines."""
    r, texts = random.Random(17), {}
    for i in range(30):
        lines = [prose(r.random(), r.choice([3, 8, 15, 30, 60, 120])) for _ in range(4)]
        if i % 3 == 0:
            lines[2] = lines[1]
        if i >= 10:
            lines[0] = changed(texts[i - 10].split("\n")[0], i, 0.04)
        texts[i] = "\n".join(lines)
    return texts | {40: None, 41: "", 42: "\n\n", 43: texts[3]}


def test_lines_against_all_pairs(spark, families):
    want = dedup_lines(families)
    rows = table(spark, families).withColumn("n_removed", F.lit("clash")).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_lines"] == len((families[i] or "").split("\n")) * (families[i] is not None) for i, r in got.items())


def test_repeated_rows_are_one_document_for_lines(spark):
    line = prose(1, 20)
    rows = spark.createDataFrame([(1, line + "\n" + line), (1, line + "\n" + line), (2, line), (None, line)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in line_dedup.dedup_lines(rows).collect()) == [(1, 1), (1, 1), (2, 1), (9, 0)]


def test_recall_on_documents(spark, sf_dir):
    """Of the near pairs of lines with one in a document whose id is divisible by 20, the share that ends in one group."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    whole = dedup_lines(docs)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, docs)).collect()}
    asked = [i for i in docs if i % 20 == 0]
    kept = lambda texts: sum(len((texts[i] or "").split("\n")) for i in asked)
    gone, missed = kept(docs) - kept(whole), kept(got) - kept(whole)
    print("lines to remove", gone, "missed", missed)
    assert 0 <= missed <= 0.1 * max(gone, 1)


def test_quality_verdicts(spark):
    """Thresholds and verdicts against plain quantiles; groups with different tails get different limits."""
    r, rows = random.Random(2), []
    for i in range(700):
        words = prose(i, r.randint(15, 60)).split()
        if i % 40 == 0:
            words = [w + "#$%" for w in words]
        if i % 2 and r.random() < 0.5:
            words[0] += "#" * r.randint(1, 9)
        if i % 55 == 0:
            words = ["a"] * 30 + [f"b{k}" for k in range(90)]
        rows.append((i, " ".join(words) + ("\nsame line\nsame line" if i % 30 == 0 else ""), None if i % 7 == 6 else "en", f"src{i % 2}" if i % 7 else None, 1))
    want = verdicts([x[:4] for x in rows])
    docs = spark.createDataFrame(rows, DOCS)
    got = {x["doc_id"]: x for x in quality.quality(docs.repartition(5)).collect()}
    for i, t, *_ in rows:
        m = measures(t)
        assert all(got[i][k] == m[k] for k in m)
        assert (got[i]["base_failed"], got[i]["rules_failed"], got[i]["kept"]) == (want[i][0], ",".join(want[i][1]), not want[i][0] and not want[i][1]), i
    limits = {(x["lang"], x["source"]): x["limit_symbols"] for x in quality.thresholds(quality.measure(docs)).collect()}
    assert limits["en", "src0"] != limits["en", "src1"]
    assert {x["doc_id"] for x in quality.keep_good(docs).collect()} == {i for i, x in got.items() if x["kept"]}
    twice = docs.where("doc_id < 3").unionAll(docs.where("doc_id < 3"))
    assert quality.quality(twice).count() == 6


def test_chat_digests(spark):
    r = random.Random(4)
    parts = ["\\", "<|", "|>", "</turn>", "\n", "a", "é", "<", "|", ">", "/turn>", "### Assistant: ", None]
    turns = [(c, t, r.choice(["user", "assistant"]), None if r.random() < 0.1 else "".join(x or "" for x in r.choices(parts, k=r.randint(0, 9)))) for c in range(80) for t in range(r.randint(1, 6))]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash")).repartition(5)
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_conversations(df)).collect()}
    for c in range(80):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        digest = hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    big = "|</turn>\\" * 900_000
    began = time.time()
    assert chat.parse(b"<|user|>\n" + re.sub(r"(\\|\||</turn>)", r"\\\1", big).encode() + b"</turn>\n") == [("user", big)]
    assert time.time() - began < 60


def test_repeated_rows_and_clashing_names(spark):
    """Repeated rows are documents of their own for row-wise operators; columns of the new names are replaced."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    text = prose(1, 60)
    rows = spark.createDataFrame([(1, text, "a", "b", "c")] * 2 + [(None, text, "a", "b", "c")], "doc_id bigint, text string, n_tokens string, ids string, n_shingles string")
    assert [r["n_email"] for r in pii.find(rows).collect()] == [0] * 3 and licenses.scan(rows).count() == 3
    encoded = bpe.encode(rows, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(encoded) == 3 and all(r["n_tokens"] == len(r["ids"]) > 0 for r in encoded)
    assert [(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_groups(rows).collect()] == [(1, 1)]
    cut = suffix_dedup.remove_repeats(rows.withColumn("n_bytes", F.lit("x")).withColumn("n_spans", F.lit("x")).withColumn("kept", F.lit("x"))).collect()
    assert [r["n_removed"] for r in cut] == [len(text)] * 3
    scored = lm_score.score(rows.withColumn("score", F.lit("x")).withColumn("n_words", F.lit("x"))).collect()
    assert len(scored) == 3 and len({r["score"] for r in scored}) == 1 and all(r["n_words"] == 60 for r in scored)


@pytest.fixture(scope="module")
def planted(tmp_path_factory, spark):
    """Documents with junk, repeated lines, near copies and a benchmark item, as tables of a directory."""
    item = prose(900, 40)
    texts = {}
    for i in range(60):
        texts[i] = "\n".join(prose(1000 * i + k, 40) for k in range(3))
    for i in range(60, 70):
        texts[i] = changed(texts[i - 60], i, 0.01)  # a near copy of a whole document
    for i in range(70, 75):
        texts[i] = prose(5 * i, 50) + " " + item + " " + prose(7 * i, 50)
    texts |= {75: "#" * 40 + " " + "# $ % " * 30, 76: "short", 77: None, 78: "", 79: prose(3, 40) + "\n" + texts[2].split("\n")[1], 80: texts[4]}
    path = f"file://{tmp_path_factory.mktemp('planted')}"
    table(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(901, 40))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, item


def test_pipeline_against_plain_stages(spark, planted):
    """Each stage and the whole run against plain Python."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, texts, item = planted
    judged = verdicts([(i, t, "en", f"src{i % 2}") for i, t in texts.items()])
    good = {i: t for i, t in texts.items() if not judged[i][0] and not judged[i][1]}
    lines = {i: t for i, t in dedup_lines(good).items() if t == good[i] or t.strip(" ")}
    groups = similar_groups(lines)
    single = {i: t for i, t in lines.items() if groups[i] == i}
    clean = {i: t for i, t in single.items() if item not in t}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, lines, single, clean), strict=True):
        docs = stage(spark, docs, path)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()}
    assert set(got) < set(texts) and not set(got) & {*range(70, 79)}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated rows pass every stage; an empty table gives an empty result with the same columns."""
    for name, rows in (("odd", [(None, prose(1, 60), None, None, None), (5, prose(2, 60), None, None, 1), (5, prose(2, 60), None, None, 1), (6, None, "en", "src0", 0), (None, None, None, None, None)]), ("none", [])):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).withColumn("n_removed", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, None), (None, prose(9, 40))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path)
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_removed", "n_tokens", "ids"]
        assert all(r["n_removed"] == "clash" for r in out.collect()) and out.count() <= len(rows)


def test_lines_that_differ_in_many_short_words(spark):
    """Within the edit budget though a quarter of the words differ and all are moved by one."""
    words = [w for i in range(30) for w in (f"{'bcdfg'[i % 5]}{'aeiou'[i // 6]}t", prose(700 + i, 1) + "qwer")]
    other = ["zzzz"] + [w[0] + "y" + w[2:] if k % 4 == 0 else w for k, w in enumerate(words)]
    docs = {1: " ".join(words), 2: " ".join(other)}
    assert dedup_lines(docs) == {1: docs[1], 2: ""}
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table(spark, docs)).collect()} == {1: docs[1], 2: ""}


def test_what_differs_between_lines_has_their_distance(spark):
    from plain_versions import edit_distance

    r, pairs = random.Random(5), [("a b c", "a b c d"), ("a b c", "x a b c"), ("a a b", "a b"), ("a b", "a a a b"), ("ab c", "a bc")]
    for i in range(60):
        words = prose(800 + i, r.randrange(1, 12)).split()
        pairs.append((" ".join(words), changed(" ".join(words), i, 0.2)))
        pairs.append((" ".join(words), " ".join(w for w in words if r.random() < 0.8) or "x"))
    pairs = [(" ".join(a.split()), " ".join(b.split())) for a, b in pairs]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup._differing(F.col("a"), F.col("b")).alias("x")).collect()
    for row in got:
        a, b = row["x"]
        left = abs(len(row["a"]) - len(row["b"])) if not a or not b else edit_distance(a, b)
        assert left == edit_distance(row["a"], row["b"]), row


def test_crossing_compares_a_share_first_and_then_what_it_left(spark):
    rows = [(1, i, 300, 7, i if i < 60 else 0) for i in range(120)]
    members = spark.createDataFrame(rows, "key bigint, h1 bigint, n int, sim bigint, g bigint")
    pairs = lambda m, share: {(r["a"], r["b"]) for r in line_dedup.crossing_pairs(m, share).collect()}
    whole, some = pairs(members, 1), pairs(members, line_dedup.SHARE)
    assert len(whole) == 59 * 60 // 2 + 59 * 60 and some < whole and len(some) <= len(whole) / 8
    # classes that the share connects are compared no more, all others are
    merged = spark.createDataFrame([(i, 0) for i in range(50)], "id bigint, component bigint")
    rest = pairs(line_dedup.open_keys(line_dedup.regrouped(members.withColumnRenamed("g", "g_"), "g_", merged)), 1)
    assert rest == {(a, b) for a, b in whole if b >= 50 and not (a < 50 and b >= 60) and not (a < 50 and b < 50)}


def test_crossing_makes_a_pair_on_one_of_its_keys(spark):
    """Pairs that share several keys are made once; a class of two levels is near at one of them only."""
    rows = [(key, i, 300, 7, i) for key in (3, 1, 2) for i in range(30)]
    rows += [(0, 100, 300, 0, 100), (0, 101, 300, (1 << 30) - 1, 101), (9, 100, 300, 5, 100), (9, 101, 300, 5, 101)]
    members = spark.createDataFrame(rows, "key bigint, h1 bigint, n int, sim bigint, g bigint")
    made = line_dedup.shared_pairs(members, 1).collect()
    assert sorted((r["a"], r["b"]) for r in made) == [(a, b) for a in range(30) for b in range(a + 1, 30)] + [(100, 101)]


def test_texts_with_much_in_common_are_compared_by_their_rare_parts(spark, monkeypatch):
    """Forty texts with two thirds in common, in twenty pairs of near copies: the pairs link, and none goes to the blocks."""
    common, texts = prose(7, 200), {}
    for i in range(40):
        texts[i] = common + " " + prose(100 + i // 2, 100) + f" end{i}"
    blocks = []
    whole = jaccard_join._cluster_links
    monkeypatch.setattr(jaccard_join, "_cluster_links", lambda many, sets: blocks.append(many.count()) or whole(many, sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(table(spark, texts)).collect()}
    assert got == similar_groups(texts) and len(set(got.values())) == 20
    assert blocks == [0]  # 78 rows before


def test_all_pairs_of_short_lines(spark):
    """Edits spread over all of a line, in lines of few or of no long words: every pair within the edit budget ends in one group."""
    r, texts = random.Random(17), {}
    for k in range(150):
        short = r.random() < 0.4
        words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 3) if short else r.randint(2, 9))) for _ in range(r.randint(5, 14))]
        line = " ".join(words)[: line_dedup.SHORT - 6].strip()
        texts[2 * k], edited = line, list(line)
        for _ in range(len(line) // 10):
            i, kind = r.randrange(len(edited)), r.randrange(3)
            edited[i : i + 1] = [[], [edited[i], "q"], ["z"]][kind]
        texts[2 * k + 1] = "".join(edited)
    want = dedup_lines(texts)
    assert sum(t == "" for t in want.values()) > 80
    assert {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(table(spark, texts)).collect()} == want


def test_lines_of_few_long_words_have_keys(spark):
    """Lines of any length that have hardly a word which votes."""
    texts = {}
    for k in range(12):
        words = [prose(900 + 100 * k + i, 1)[:3] for i in range(80)]
        texts[2 * k] = " ".join(words)
        texts[2 * k + 1] = " ".join(words[:40] + ["qqq"] + words[41:])
    assert {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(table(spark, texts)).collect()} == dedup_lines(texts)
