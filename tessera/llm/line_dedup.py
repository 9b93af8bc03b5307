"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised (ASCII-folded case, digits as 0, punctuation as blanks).
Equal normalised lines form a class. Lines of fewer than five words, and so all
lines of scripts without blanks, are in a class with those that are equal as
they stand, blanks around them aside, and have no fuzzy links.

Of each longer class a SimHash is taken (Charikar, "Similarity estimation
techniques from rounding algorithms", STOC 2002): the words' random vectors are
summed, and the signs of the sums are the bits. Each word votes in one block of
bits only, chosen by its hash, so a changed word leaves all blocks but two as
they are, and a block whose words are unchanged has the same sums. By the
pigeonhole principle near lines agree in some block; classes meet on it. Signs of
eight blocks are too few bits to join on, so the join takes the sums behind them.
The number of blocks grows with the line, of which the first eight are used, so
a block stands for four to eight words whatever the length; short lines join on
several blocks at once. Blocks of too few words are joined with the ones after
them, so no line is without keys.

Lines of up to SHORT characters, whose few words leave blocks no choice, meet on
stretches of characters as well, which is exact (Li et al., "Pass-Join: A
Partition-based Method for Similarity Joins", VLDB 2011): if at most t edits lead
from a line to a longer one, one of t + 1 stretches that make up the longer one
is in the shorter one, at a place that differs by few. Instead of SimHashes these
have counts of letters, of which an edit changes two by one at most.

Each class is compared with the pivots of its blocks first, the members nearest
to the majority of the SimHashes there, then with a share and last with all of
what is still not connected to it, so that a large group of near copies is not
expanded into its pairs. Only pairs with near SimHashes are compared. A pair is
a link if the edit distance of the normalised lines is at most a tenth of the
longer one. Of each connected group the occurrence with the smallest (doc_id,
line number) stays.

Everything stays in the JVM, without user-defined functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.storage import materialize

#: Lines with fewer words repeat only lines that are equal without normalisation.
LEAST_WORDS = 5
#: Words of fewer letters have no votes: they are too common to tell lines apart.
LEAST_LETTERS = 4
#: In lines of fewer characters for each word all words vote, as in tables of numbers; in lines of more the longer ones do, in those between both, at levels of their own.
TERSE, WORDY = 4.8, 3.2
ALL_VOTE = 64
#: Blocks of a SimHash that are used, and bits of a block.
BLOCKS = 8
BITS = 5
#: Words that the blocks of a key need, at level 0 and above.
LEAST_VOTES = (3, 4)
#: Bits in which the SimHashes of compared lines may differ, of BLOCKS * BITS. Of 1009 near pairs of the sf0.1 documents none differs in more.
RADIUS = 10
#: Percent of the longer line that may be edited.
EDITS = 10
#: Bits of a key that are kept. Keys that only these make equal cost comparisons, no links.
KEY_BITS = 48
#: Normalised lines of at most so many characters meet on stretches of characters, too; at most 60, as the bits for letters are few.
SHORT = 60
#: The letters that these lines count, each up to 8.
LETTERS = "etaoinsr"
#: The bit that such keys have.
STRETCH = 1 << KEY_BITS
#: Of so many pairs between groups one is compared before the others.
SHARE = 16

#: The sum of a block: BITS sums of vector components of 7 bits each, 10 bits apart, and the number of votes above them.
_LANE, _COMPONENT, _COUNT = 10, 127, 10 * BITS
_ONES = sum(1 << (_LANE * i) for i in range(BITS))
#: The hash bits that choose a word's block, of 16 bits.
_CHOICE = 47
_SUMS = [f"s{j}" for j in range(BLOCKS)]
#: Lines of more characters are aligned in pieces of so many words first.
WHOLE, PIECE = 1200, 50
#: Percent of a piece that may be edited; more counts as all of it.
PIECE_EDITS = 20


#: One or more of [\s\p{Punct}]; character by character, as Java looks single characters up in a table but not classes and ranges.
_BETWEEN = r"""[ \t\n\x0B\f\r!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""


def normalized_words(line: Column) -> Column:
    """The words of a line after normalisation, as an array."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(line), "[123456789]", "0"), _BETWEEN), "")


def levels(words: Column) -> Column:
    """The levels of a line of so many words: 0 below 24, one more with each doubling; also the level of a line a tenth shorter."""
    level = lambda x: F.greatest(F.length(F.bin(F.floor(x / 3).cast("long"))) - 3, F.lit(0))
    return F.array_distinct(F.array(level(words), level(words * (100 - EDITS) / 100)))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, words, n, h1, h2) of the lines with a word; ``n`` is the length, null for lines of fewer than LEAST_WORDS, which are hashed as they stand."""
    split = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.length("raw") > 0)
    # the array around the words keeps the filter from being evaluated with a copy of their expression
    words = split.select("doc_id", "line", "raw", F.explode(F.array(normalized_words(F.col("raw")))).alias("words")).where(F.size("words") > 0)
    short = F.size("words") < LEAST_WORDS
    # one string is hashed faster than the words of an array
    text = F.when(short, F.trim("raw", F.lit(" \t\r"))).otherwise(F.array_join("words", " "))
    whole = words.select("doc_id", "line", "words", short.alias("short"), F.explode(F.array(text)).alias("t"))
    h1, h2 = _hashes(F.col("t"), F.when(F.col("short"), 2).otherwise(1))
    return whole.select("doc_id", "line", "words", F.when(~F.col("short"), F.length("t")).alias("n"), h1.alias("h1"), h2.alias("h2"))


def _hashes(text: Column, seed: Column) -> tuple[Column, Column]:
    """The two hashes of a class."""
    return F.xxhash64(text), F.xxhash64(seed, text)


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h1, h2, n, t, tail, level, main, s0...): the lines with their lengths and block sums.

    A row for each level of a line, one of them ``main``; ``n`` and ``level``
    are null for lines of fewer than LEAST_WORDS. ``t`` is the normalised line
    where it has at most SHORT characters, in the main row; ``tail`` tells the
    last word in order where a line has more blocks than are used.
    """
    size = F.size("words")
    fuzzy = size >= LEAST_WORDS
    none = F.array(F.lit(None).cast("int"))
    each = F.transform(levels(size), lambda x: x + ALL_VOTE)
    own = F.when(F.col("n") >= TERSE * size, levels(size)).when(F.col("n") >= WORDY * size, F.concat(levels(size), each)).otherwise(each)
    leveled = lines(docs).withColumn("level", F.explode(F.when(fuzzy, own).otherwise(none)))
    leveled = leveled.withColumn("main", ~fuzzy | (F.col("level") == levels(size)[0] + F.when(F.col("n") >= WORDY * size, 0).otherwise(ALL_VOTE)))
    leveled = leveled.withColumn("tail", F.when(F.col("level") % ALL_VOTE > 2, F.xxhash64(F.array_max("words"))))
    leveled = leveled.withColumn("t", F.when(F.col("main") & (F.col("n") <= SHORT), F.array_join("words", " ")))
    # the empty word stands for the line itself, whatever votes it has
    voters = leveled.select("doc_id", "line", "h1", "h2", "n", "t", "tail", "level", "main", F.explode(F.when(fuzzy, F.array_append("words", "")).otherwise(F.array(F.lit("")))).alias("word"))
    hashed = voters.where((F.col("word") == "") | (F.length("word") >= LEAST_LETTERS) | (F.col("level") >= ALL_VOTE)).select("*", F.when(F.col("word") != "", F.xxhash64("word")).alias("h"))
    level = F.col("level") % ALL_VOTE
    blocks = F.when(level == 0, 5).when(level == 1, BLOCKS).otherwise(F.call_function("shiftleft", F.lit(2).cast("long"), level))
    block = F.shiftrightunsigned(F.shiftrightunsigned("h", _CHOICE).bitwiseAND(F.lit(0xFFFF)) * blocks, 16)
    vector = F.col("h").bitwiseAND(F.lit(_ONES * _COMPONENT)) + F.lit(1 << _COUNT)
    votes = hashed.select("doc_id", "line", "h1", "h2", "n", "t", "tail", "level", "main", block.alias("block"), vector.alias("vector")).where(F.col("block").isNull() | (F.col("block") < BLOCKS))
    # sums of over 8000 votes overflow: all of these count as equal
    total = lambda j: F.coalesce(F.try_sum(F.when(F.col("block") == j, F.col("vector")).otherwise(F.lit(0))), F.lit(-1))
    return votes.groupBy("doc_id", "line", "h1", "h2", "n", "t", "tail", "level", "main").agg(*[total(j).alias(c) for j, c in enumerate(_SUMS)])


def simhash(sums: Column) -> Column:
    """BLOCKS * BITS bits, the signs of the centred sums of an array of blocks: bit i of block j stands at 10 * i + 7 - j."""
    half, lanes = 1 << (_LANE - 1), F.lit((1 << _COUNT) - 1)

    def add(bits: Column, s: Column) -> Column:
        # half of what so many components may sum to is subtracted from all lanes at once; what is not negative reaches the highest bit of its lane
        centred = s.bitwiseAND(lanes) + (F.lit(half) - F.shiftrightunsigned(s, _COUNT) * 64) * F.lit(_ONES)
        return F.shiftleft(bits, 1).bitwiseOR(F.shiftrightunsigned(centred.bitwiseAND(F.lit(_ONES * half)), _LANE - 1))

    return F.aggregate(sums, F.lit(0).cast("long"), add)


def block_keys(sums: Column, level: Column, tail: Column | None = None) -> Column:
    """The keys to join on: a block each, two neighbouring blocks at level 1, three of five at level 0; where these have too few words, with the blocks after them, twice as many each time."""
    at = [F.get(sums, F.lit(i)) for i in range(BLOCKS)]
    enough = lambda s, least: F.shiftrightunsigned(s, _COUNT) >= least
    pairs = [F.try_add(at[j], at[(j + 1) % BLOCKS]) for j in range(BLOCKS)]
    fours = [F.try_add(pairs[j], pairs[(j + 2) % BLOCKS]) for j in range(BLOCKS)]
    # with all blocks, however few words these have: the words of a line may all be in others
    whole = F.xxhash64(level, F.lit(-1), F.array_join(sums, " "), *([] if tail is None else [tail]))
    named = lambda j, *runs: F.coalesce(*[F.when(enough(s, LEAST_VOTES[1]), F.xxhash64(level, F.lit(j + BLOCKS * k), s)) for k, s in enumerate(runs)], whole)
    few = [F.try_add(F.try_add(at[a], at[b]), at[c]) for a, b, c in combinations(range(5), 3)]
    short = [F.when(enough(s, LEAST_VOTES[0]), F.xxhash64(level, F.lit(j), s)).otherwise(whole) for j, s in enumerate(few)]
    ring = [named(j, pairs[j], fours[j]) for j in range(BLOCKS)]
    single = [named(j, at[j], pairs[j], fours[j]) for j in range(BLOCKS)]
    return F.array_distinct(F.when(level % ALL_VOTE == 0, F.array(*short)).when(level % ALL_VOTE == 1, F.array(*ring)).otherwise(F.array(*single)))


def stretch_keys(classes: DataFrame) -> DataFrame:
    """(long, id) of the classes (id, n, t) of short lines: the stretches that make up a line, and with -1 - id those of its own that a line as long or longer may have, where that may have them."""
    longer = classes.select("id", "n", "t", F.explode(F.sequence("n", F.col("n") + F.floor(F.col("n") / 9).cast("int") + 1)).alias("l"))
    budget = F.floor(F.col("l") * EDITS / 100).cast("int")
    longer = longer.select("*", budget.alias("most"), (F.col("l") - F.col("n")).alias("more")).where(f"more <= most AND l <= {SHORT}")
    parts = longer.select("*", F.explode(F.sequence(F.lit(0), "most")).alias("i"))
    edge = lambda i: F.floor(F.col("l") * i / (F.col("most") + 1)).cast("int")
    parts = parts.select("*", edge(F.col("i")).alias("at"), (edge(F.col("i") + 1) - edge(F.col("i"))).alias("size"))
    # a place moves by the edits before it at most, and by those after it as seen from the end
    parts = parts.withColumn("low", F.expr("greatest(0, at - i, at - more - (most - i))")).withColumn("high", F.expr("least(n - size, at + i, at - more + (most - i))"))
    places = parts.where("low <= high").select("*", F.explode(F.sequence("low", "high")).alias("start"))
    own = (F.col("more") == 0) & (F.col("start") == F.col("at"))
    stretch = F.substring("t", F.col("start") + 1, F.col("size"))
    return places.select(F.xxhash64("l", "i", stretch).alias("long"), F.when(own, F.col("id")).otherwise(-1 - F.col("id")).alias("id"))


def letter_bits(text: Column) -> Column:
    """64 bits, eight for each of LETTERS: as many ones as the text has of it, up to eight. An edit changes two of them at most."""
    bits = None
    for j, letter in enumerate(LETTERS):
        count = F.least(F.lit(8), F.length(text) - F.length(F.translate(text, letter, "")))
        ones = F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("long"), count) - 1, 8 * j)
        bits = ones if bits is None else bits.bitwiseOR(ones)
    return bits


def crowded_keys(classes: DataFrame) -> DataFrame:
    """(key, h1, h2, first, n, k, sim): classes by block key or stretch; keys of a single class are left out."""
    sums = F.array(*_SUMS)
    # what is shuffled for every key is short: some bits of it, and the number of the class, which has few different bytes
    short = F.shiftrightunsigned("long", 64 - KEY_BITS)
    blocks = classes.select("id", F.explode(block_keys(sums, F.col("level"), F.col("tail"))).alias("long")).select(short.alias("key"), "id")
    stretches = stretch_keys(classes.where("t IS NOT NULL")).select(short.bitwiseOR(F.lit(STRETCH)).alias("key"), "id")
    keyed = blocks.unionByName(stretches).repartition("key")
    # stretches that no line is made up of lead to none
    several = keyed.groupBy("key").agg(F.count("*").alias("members"), F.max("id").alias("most")).where("members > 1 AND most >= 0").select("key", "members")
    # most keys are of a single class: what else is known of a class joins the few that are left
    crowded = keyed.join(several.hint("shuffle_hash"), "key").withColumn("id", F.greatest("id", -1 - F.col("id")))
    known = crowded.join(classes.select("id", "h1", "h2", "first", "n", "k", simhash(sums).alias("sim"), letter_bits(F.col("t")).alias("letters")), "id")
    return known.withColumn("sim", F.when(F.col("key") >= STRETCH, F.col("letters")).otherwise(F.col("sim"))).drop("id", "letters")


def with_pivots(crowded: DataFrame) -> DataFrame:
    """(key, h1, n, sim, p, p_n, p_sim): the pivot of a key is the member nearest to the majority of each bit, of several the most frequent one.

    Counts of over 2**29 members overflow, which only makes another member the pivot.
    """
    pairs = [(j, (0, 3)) for j in range(BLOCKS)] + [(j, (1, 4)) for j in range(BLOCKS)] + [(j, (2,)) for j in range(BLOCKS)]
    dealt = crowded.drop("h2", "first").repartition("key")
    masks = [sum(1 << (_LANE * i) for i in lanes) << j for j, lanes in pairs]
    # two counts in each sum, 30 bits apart
    low = [j + _LANE * lanes[0] for j, lanes in pairs]
    counts = [F.coalesce(F.try_sum(F.shiftrightunsigned(F.col("sim").bitwiseAND(F.lit(m)), x)), F.lit(0)).alias(f"c{x}") for m, x in zip(masks, low, strict=True)]
    # of two members either is a pivot for the other
    counted = dealt.where("members > 2").groupBy("key").agg((F.max("members") / 2).alias("half"), *counts)
    major = None
    for (_, lanes), x in zip(pairs, low, strict=True):
        for i in range(len(lanes)):
            count = F.shiftrightunsigned(f"c{x}", 30 * i).bitwiseAND(F.lit((1 << 29) - 1))
            bit = F.shiftleft((count > F.col("half")).cast("long"), x + 30 * i)
            major = bit if major is None else major.bitwiseOR(bit)
    placed_ = dealt.join(counted.select("key", major.alias("middle")), "key", "left").withColumn("middle", F.coalesce("middle", "sim"))
    pivots = placed_.groupBy("key").agg(F.min(F.struct(_apart("sim", "middle").alias("d"), (-F.col("k")).alias("k"), "h1", "n", "sim")).alias("p"))
    return dealt.join(pivots, "key").select("key", "h1", "n", "sim", F.col("p.h1").alias("p"), F.col("p.n").alias("p_n"), F.col("p.sim").alias("p_sim"))


def _apart(a: str, b: str) -> Column:
    """Bits that differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _near(key: str, a: str, b: str, sim_a: str, sim_b: str) -> Column:
    """Lengths that the edit budget allows, and SimHashes within the radius; for stretches, letters that it allows."""
    longer = F.greatest(a, b)
    radius = F.when(F.col(key) >= STRETCH, 2 * F.floor(longer * EDITS / 100)).otherwise(RADIUS)
    return (F.abs(F.col(a) - F.col(b)) * 100 <= longer * EDITS) & (_apart(sim_a, sim_b) <= radius)


def pivot_pairs(crowded: DataFrame) -> DataFrame:
    """(a, b): the pivots and the classes near them."""
    near = crowded.where((F.col("h1") != F.col("p")) & _near("key", "n", "p_n", "sim", "p_sim"))
    return near.select(F.least("h1", "p").alias("a"), F.greatest("h1", "p").alias("b")).distinct()


def regrouped(rows: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """``rows`` with the group ``g`` of what ``column`` names, by ``groups`` (id, component); what has no group is one by itself."""
    named = groups.select(F.col("id").alias("__id"), F.col("component").alias("__g"))
    joined = rows.join(named, F.col(column) == F.col("__id"), "left")
    return joined.withColumn("g", F.coalesce("__g", column)).drop("__id", "__g")


def open_keys(members: DataFrame) -> DataFrame:
    """The rows (key, h1, n, sim, g) of the keys whose members are not all of one group."""
    several = members.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("key")
    return members.join(several, "key")


def crossing_pairs(members: DataFrame, share: int) -> DataFrame:
    """(a, b, g_a, g_b): near classes of different groups that share a key; of ``share`` such pairs about one, by a hash of the pair."""
    # classes of two levels may be near at both
    return shared_pairs(members, share).distinct()


def shared_pairs(members: DataFrame, share: int) -> DataFrame:
    """As crossing_pairs, made on the smallest key that a pair shares, not on all of them; once for each level."""
    # a class of two levels has a SimHash for each, which may be near at one of them only
    own = members.groupBy("h1", "sim").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    told = members.join(own, ["h1", "sim"])
    left = told.select("key", F.col("h1").alias("a"), F.col("n").alias("n_a"), F.col("sim").alias("sim_a"), F.col("g").alias("g_a"), F.col("keys").alias("keys_a"))
    right = told.select(F.col("key").alias("key_b"), F.col("h1").alias("b"), F.col("n").alias("n_b"), F.col("sim").alias("sim_b"), F.col("g").alias("g_b"), F.col("keys").alias("keys_b"))
    apart = (F.col("a") < F.col("b")) & (F.col("g_a") != F.col("g_b")) & _near("key", "n_a", "n_b", "sim_a", "sim_b")
    if share > 1:
        apart &= F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0
    apart &= F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key")
    return left.join(right, (F.col("key") == F.col("key_b")) & apart).select("a", "b", "g_a", "g_b")


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(h1, h2, t): the normalised line of each class (h1, h2, first), read from the document of its first occurrence."""
    places = classes.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line", "h1", "h2")).alias("places"))
    touched = docs.join(places.hint("shuffle_hash"), "doc_id").select(F.split("text", "\n").alias("lines"), "places")
    raw = touched.select(F.inline(F.transform("places", lambda p: F.struct(p["h1"].alias("h1"), p["h2"].alias("h2"), F.get("lines", p["line"]).alias("raw")))))
    texts = raw.select("h1", "h2", F.explode(F.array(F.array_join(normalized_words(F.col("raw")), " "))).alias("t"))
    # rows that share a doc_id may have another line at that place
    h1, h2 = _hashes(F.col("t"), F.lit(1))
    own = texts.where((h1 == F.col("h1")) & (h2 == F.col("h2")))
    return own.groupBy("h1", "h2").agg(F.min("t").alias("t"))


def _bounded(a: Column, b: Column, most: Column) -> Column:
    """The edit distance of two strings, -1 over ``most``."""
    return F.call_function("levenshtein", a, b, most)


def _word_by_word(a: Column, b: Column) -> Column:
    """At least the edit distance of two lines: that of their words, pair by pair."""
    apart = lambda x, y: F.when(x == y, F.lit(0)).otherwise(F.coalesce(F.levenshtein(x, y), F.coalesce(F.length(x), F.length(y)) + 1))
    return F.aggregate(F.zip_with(F.split(a, " "), F.split(b, " "), apart), F.lit(0), lambda total, x: total + x)


def _piecewise(a: Column, b: Column) -> Column:
    """At least the edit distance of two lines: that of their words, PIECE after PIECE."""
    part = lambda words, i: F.array_join(F.slice(words, i * PIECE + 1, F.lit(PIECE)), " ")
    ends = lambda words, i: (F.size(words) <= i * PIECE).cast("int")  # noqa: E731  a blank more for each piece that only one line has

    def apart(x: Column) -> Column:
        longer = F.greatest(F.length(x["a"]), F.length(x["b"]))
        distance = _bounded(x["a"], x["b"], (longer * PIECE_EDITS / 100).cast("int"))
        return F.when(distance < 0, longer).otherwise(distance) + x["ends"]

    def pieced(p: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.size(p["a"]), F.size(p["b"])) - 1) / PIECE).cast("int"))
        parts = F.transform(pieces, lambda i: F.struct(part(p["a"], i).alias("a"), part(p["b"], i).alias("b"), (ends(p["a"], i) + ends(p["b"], i)).alias("ends")))
        return F.aggregate(parts, F.lit(0), lambda total, x: total + apart(x))

    # the array keeps the lines from being split anew for every piece
    return F.transform(F.array(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))), pieced)[0]


def _differing(a: Column, b: Column) -> Column:
    """(a, b): two lines without the words that they begin and end with in common, which takes nothing from their edit distance if words of both are left."""
    one = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: ~u.eqNullSafe(v)), True).cast("int")  # noqa: E731  0 if they are equal
    rest = lambda words, i: F.slice(words, i, F.greatest(F.size(words) - i + 1, F.lit(0)))
    stretch = F.transform(F.array(F.struct(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.greatest(one(p["a"], p["b"]), F.lit(1)).alias("i")))
    cut = F.transform(stretch, lambda p: F.struct(F.reverse(rest(p["a"], p["i"])).alias("a"), F.reverse(rest(p["b"], p["i"])).alias("b")))
    ends = F.transform(cut, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.greatest(one(p["a"], p["b"]), F.lit(1)).alias("i")))
    joined = lambda words, i: F.array_join(F.reverse(rest(words, i)), " ")
    return F.transform(ends, lambda p: F.struct(joined(p["a"], p["i"]).alias("a"), joined(p["b"], p["i"]).alias("b")))[0]


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) within the edit budget, with the (h1, h2) of both sides and their other columns.

    Aligning takes time with the square of the length. So only what lies between
    the first and the last differing word is aligned, and pairs whose words, in
    order or in pieces, are near enough pass without it.
    """
    left = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("t").alias("ta"))
    right = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("t").alias("tb"))
    longer = F.greatest(F.length("ta"), F.length("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("allowed", (longer * EDITS / 100).cast("int")).withColumn("more", F.abs(F.length("ta") - F.length("tb")))
    # few bytes, much work: dealt evenly over as many tasks as a shuffle has
    both = both.where("more <= allowed").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    # the arrays keep the alignments from being moved ahead of the dealing, and what differs from being computed again
    both = both.withColumn("x", F.explode(F.array(_differing(F.col("ta"), F.col("tb")))))
    ta, tb, allowed = F.col("x.a"), F.col("x.b"), F.col("allowed")
    in_pieces = (F.greatest(F.length(ta), F.length(tb)) > WHOLE) & (_piecewise(ta, tb) <= allowed)
    # where one line has all words of the other, "more" is the distance
    close = F.when((ta == "") | (tb == ""), True).when(_word_by_word(ta, tb) <= allowed, True).when(in_pieces, True).otherwise(_bounded(ta, tb, allowed) >= 0)
    return both.select(*pairs.columns, "a2", "b2", F.explode(F.array(close)).alias("close")).where("close").drop("close")


def grouped_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(h1, h2, component): the classes that are linked to others, with links enough to connect all that are near and share a key."""
    keys = materialize(crowded_keys(classes.where("n IS NOT NULL")), "lines-keys")
    crowded = materialize(with_pivots(keys), "lines-pivots")
    texts = materialize(_texts(docs, keys.select("h1", "h2", "first").distinct()), "lines-texts")
    links = materialize(_links(pivot_pairs(crowded), texts), "lines-links")
    groups = materialize(connected_components(links.select("a", "b")), "lines-groups")
    left = materialize(open_keys(regrouped(crowded.select("key", "h1", "n", "sim"), "h1", groups)), "lines-open")
    # most classes outside a group are near many of its members: a few pairs connect them, and spare the others
    some = materialize(_links(crossing_pairs(left, SHARE), texts), "lines-some")
    merged = connected_components(some.select("g_a", "g_b"))
    rest = materialize(_links(crossing_pairs(open_keys(regrouped(left.withColumnRenamed("g", "g_"), "g_", merged)), 1), texts), "lines-rest")
    crossing = some.unionByName(rest)
    ends = links.unionByName(crossing.select("a", "b", "a2", "b2")).select(F.inline(F.array(F.struct(F.col("a").alias("h1"), F.col("a2").alias("h2")), F.struct(F.col("b").alias("h1"), F.col("b2").alias("h2"))))).distinct()
    placed = regrouped(ends, "h1", groups).withColumnRenamed("g", "g_")
    return regrouped(placed, "g_", connected_components(crossing.select("g_a", "g_b"))).select("h1", "h2", F.col("g").alias("component"))


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, removed): the numbers (from 0) of the lines of each document that repeat an earlier one."""
    found = materialize(signed_lines(docs), "lines")
    first = F.min(F.struct("doc_id", "line")).alias("first")
    same = [F.first(c).alias(c) for c in ("n", "t", "tail", *_SUMS)]  # equal in a class
    grown = found.groupBy("h1", "h2", "level", "main").agg(first, F.count("*").alias("k"), *same)
    # the numbers are read from the written table only, so they don't change when a task runs again
    classes = materialize(grown.withColumn("id", F.monotonically_increasing_id()), "lines-classes")
    main = classes.where("main").select("h1", "h2", "first", "k")
    grouped = materialize(grouped_classes(docs, classes).join(main, ["h1", "h2"]).select("h1", "h2", "component", "first"), "lines-members")
    stays = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    fuzzy = grouped.join(stays, "component").select("h1", "h2", "stays")
    exact = main.where("k > 1").select("h1", "h2", F.col("first").alias("stays"))
    keepers = exact.join(fuzzy, ["h1", "h2"], "left_anti").unionByName(fuzzy)
    gone = found.where("main").select("doc_id", "line", "h1", "h2").join(keepers, ["h1", "h2"]).where("doc_id <> stays.doc_id OR line <> stays.line")
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, and the columns ``counts``: lines, and lines removed.

    A null text stays null with 0 lines. Rows without a ``doc_id`` stay as they
    are. Rows that share a ``doc_id`` count as one document: lines at the same
    place are one occurrence. Columns named as ``counts`` are replaced; an empty
    table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in counts]
    removed = duplicate_lines(docs.select("doc_id", "text")).withColumnRenamed("removed", "__removed")
    parts = docs.select(*columns).join(removed.hint("shuffle_hash"), "doc_id", "left").withColumn("__lines", F.split("text", "\n"))
    count = F.coalesce(F.size("__removed"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    cut = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    text = F.when((count > 0) & F.col("text").isNotNull(), cut).otherwise(F.col("text"))
    return parts.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias(counts[0]),
        count.cast("long").alias(counts[1]),
    )
