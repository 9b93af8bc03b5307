"""Plain Python versions of corpus operators, for tests: no Spark, all pairs."""

import re
from collections import Counter

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edit_distance(a, b, most=10**9):
    """Levenshtein distance; a number over ``most`` if it is more."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def stretch_distance(a, b):
    """Fewest edits that turn ``a`` into some stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def groups(ids, linked):
    """The smallest id of each id's component."""
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in linked:
        x, y = root(a), root(b)
        group[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar_groups(texts):
    """component_id of each doc_id by five-word shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b])]
    return groups(sets, links)


def normalized(line):
    """The words of a line as line deduplication compares them."""
    out = []
    for word in re.split(r"[\s!-/:-@\[-`{-~]+", re.sub("[0-9]", "0", line.lower()), flags=re.ASCII):
        if word:
            out.append(word)
    return out


def near_lines(a, b, edits=10):
    budget = max(len(a), len(b)) * edits // 100
    if abs(len(a) - len(b)) > budget:
        return False
    x, y = Counter(a), Counter(b)
    if max(sum((x - y).values()), sum((y - x).values())) > budget:  # an edit changes one character
        return False
    return edit_distance(a, b, budget) <= budget


def dedup_lines(texts, least_words=5):
    """doc_id -> text without repeated and nearly repeated lines, comparing all pairs of lines."""
    first, place = {}, {}
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            words = normalized(line)
            if words:
                key = " ".join(words) if len(words) >= least_words else ("short", line.strip(" \t\r"))
                place[i, n] = key
                first.setdefault(key, (i, n))
    long = [k for k in first if isinstance(k, str)]
    number = {k: n for n, k in enumerate(long)}
    linked = [(number[a], number[b]) for x, a in enumerate(long) for b in long[x + 1 :] if near_lines(a, b)]
    group = groups(range(len(long)), linked)
    stays = {}
    for k in first:
        g = group[number[k]] if isinstance(k, str) else k
        stays[g] = min(stays.get(g, first[k]), first[k])
    keep = lambda p: p not in place or stays[group[number[place[p]]] if isinstance(place[p], str) else place[p]] == p
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if keep((i, n))) for i, t in texts.items()}


def measures(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times, cover = Counter(runs), set()
    for k, x in enumerate(runs):
        if times[x] > 1:
            cover.update(range(k, k + 8))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
    }


def _floor(value):
    """The least value of a sketch bucket: exact below 16, then 16 buckets for each doubling."""
    if value < 16:
        return value
    step = 1 << (value.bit_length() - 5)
    return value // step * step


def verdicts(rows):
    """doc_id -> (base_failed, names of failed rules), of rows (doc_id, text, lang, source)."""
    found = {i: (measures(t), lang, source) for i, t, lang, source in rows}
    values = {
        "symbols": lambda m: 1000 * m["n_symbols"] // max(m["n_words"], 1), "word_length": lambda m: 1000 * m["word_chars"] // max(m["n_words"], 1),
        "dup_lines": lambda m: 1000 * m["n_dup_lines"] // max(m["n_lines"], 1), "repeats": lambda m: 1000 * m["n_repeat_words"] // max(m["n_words"], 1),
    }
    out = {}
    for i, (m, lang, source) in found.items():
        for same in (lambda x: x[1:] == (lang, source), lambda x: x[1] == lang, lambda x: True):
            group = [x[0] for x in found.values() if same(x)]
            if len(group) >= quality.LEAST_GROUP:
                break
        failed = []
        for rule in quality.RULES:
            own = sorted(values[rule.name](x) for x in group)
            q10, q50, q90 = (_floor(own[-(-len(own) * q // 10) - 1]) for q in (1, 5, 9))
            v = values[rule.name](m)
            if v > q90 + rule.reach * max(q90 - q50, rule.least) or (rule.low and v < q10 - rule.reach * max(q50 - q10, rule.least)):
                failed.append(rule.name)
        out[i] = (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"], failed)
    return out
