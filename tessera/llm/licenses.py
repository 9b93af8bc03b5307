"""License statements found by matching marked-up templates.

A template is the wording of a notice with markup: ``[[ ... ]]`` encloses an
optional region, ``{{n}}`` stands for up to ``n`` replaceable words. Templates
are compiled into token automata whose states carry words; a stretch of a text
is accepted if its words drive an automaton from start to end, so all mandatory
wording has to be there exactly, and optional and replaceable regions may vary.

Words are runs of ASCII letters and digits and of non-ASCII characters, with
A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.arrow_text import as_text, slices

#: Phrases whose consecutive words count as a statement by themselves, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices by label. Wordings are those of the public license texts.
TEMPLATES = (
    ("gpl-notice", "[[this work is]] [[this program is]] [[this file is]] [[released]] [[licensed]] [[distributed]] under [[the terms of]] the gnu [[lesser]] [[affero]] general public license [[as published by the free software foundation]] [[either]] [[version]] {{1}} [[or any later version]] [[or at your option any later version]]"),
    ("gpl-body", "this program is free software you can redistribute it and or modify it under the terms of the gnu {{1}} [[general public]] license as published by the free software foundation"),
    ("apache-notice", "[[this work is]] [[this project is]] [[released]] [[licensed]] under the apache license [[version]] [[2 0]] [[the license]]"),
    ("apache-body", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit-notice", "[[this work is]] [[this project is]] [[released]] [[licensed]] [[distributed]] under [[the terms of]] the mit license"),
    ("mit-body", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd-body", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-notice", "[[released]] [[licensed]] [[distributed]] under [[the terms of]] the [[2 clause]] [[3 clause]] [[new]] [[simplified]] bsd license"),
    ("cc-by-notice", "[[this work is]] [[this article is]] [[released]] [[licensed]] [[distributed]] under [[a]] [[the]] cc by [[nc]] [[sa]] [[nd]] {{2}}"),
    ("cc-by-full", "[[this work is]] licensed under [[a]] [[the]] creative commons attribution [[noncommercial]] [[non commercial]] [[sharealike]] [[share alike]] [[noderivatives]] {{2}} [[international]] license"),
    ("isc-body", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("spdx", "spdx license identifier {{4}}"),
    ("reserved", "copyright [[c]] {{12}} all rights reserved"),
    ("mit-full", "[[the]] [[mit license]] [[mit]] [[copyright [[c]] {{16}}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall [[the]] {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-full", "[[isc license]] [[copyright [[c]] {{16}}]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and [[the]] {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall [[the]] {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-full", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[[[3]] neither the name of [[the]] {{10}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] this software is provided by [[the]] {{10}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall [[the]] {{10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache-header", "[[copyright {{16}}]] licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] {{6}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-header", "{{8}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version {{8}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details [[you should have received a copy of the gnu [[lesser]] [[affero]] general public license along with {{6}} if not see {{8}}]]"),
    ("zlib-full", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)

#: ASCII other than lower-case letters and digits separates words; A-Z is lowered.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of_bytes(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """States are places in a template; ``steps[s]`` are (word or None for any, next state), ``skips[s]`` states reached freely."""

    label: str
    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    literals: set[bytes] = field(default_factory=set)

    def _state(self) -> int:
        self.steps.append([])
        self.skips.append([])
        return len(self.steps) - 1

    @staticmethod
    def compile(label: str, template: str) -> Automaton:
        """Words become steps, ``[[ ]]`` a skip around its words, ``{{n}}`` n steps on any word that may end early."""
        a = Automaton(label)
        at, opened = 0, []
        for token in template.replace("[[", " [[ ").replace("]]", " ]] ").split():
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                a.skips[opened.pop()].append(at)
            elif token.startswith("{{"):
                first, ends = at, []
                for _ in range(int(token[2:-2])):
                    new = a._state()
                    a.steps[at].append((None, new))
                    ends.append(at)
                    at = new
                for e in [first, *ends[1:]]:
                    a.skips[e].append(at)
            else:
                new = a._state()
                a.steps[at].append((token.encode(), new))
                if not opened:
                    a.literals.add(token.encode())
                at = new
        return a

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def begins(self) -> set[bytes]:
        """Words a match can start with; replaceable words in front are left to the text before it."""
        return {w for s in self.closure({0}) for w, _ in self.steps[s] if w is not None}

    def match(self, words: list[bytes], start: int) -> int:
        """The longest end of a match from ``start``, or -1."""
        final, best = len(self.steps) - 1, -1
        states = self.closure({0})
        for i in range(start, len(words)):
            states = self.closure({t for s in states for w, t in self.steps[s] if w is None or w == words[i]})
            if not states:
                break
            if final in states:
                best = i + 1
        return best


class Matcher:
    """All templates; a text is only walked if it has every mandatory word of a template."""

    def __init__(self, templates=TEMPLATES):
        self.automata = [Automaton.compile(label, t) for label, t in templates]
        self.begins = [a.begins() for a in self.automata]

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of accepted stretches, the longest first where they begin together, not overlapping within a template."""
        have, found = set(words), []
        for a, begins in zip(self.automata, self.begins, strict=True):
            if not a.literals <= have:
                continue
            done = 0
            for start in (i for i, w in enumerate(words) if w in begins):
                if start >= done and (end := a.match(words, start)) > start:
                    found.append((start, end, a.label))
                    done = end
        return sorted(found)


def phrase_places(words: list[bytes]) -> list[tuple[int, int, str]]:
    """(start, end, label) of each place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at, before, start = joined.find(needle), 0, 0
        while at >= 0:
            start += joined.count(b" ", before, at)
            before = at
            found.append((start, start + phrase.count(" ") + 1, label))
            at = joined.find(needle, at + 1)
    return sorted(found)


_FOUND = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_matcher: list[Matcher] = []


def _row(text: bytes) -> tuple:
    words = words_of_bytes(text)
    if not any(x in words for x in (b"license", b"licensed", b"licence", b"cc", b"copyright", b"permission", b"redistribution", b"unencumbered")):
        return (len(words), 0, None, None, "", "", 0.0)
    if not _matcher:
        _matcher.append(Matcher())
    base, templates = phrase_places(words), _matcher[0].matches(words)
    covered = set()
    for start, end, _ in (*base, *templates):
        covered.update(range(start, end))
    base_labels = sorted({x[2] for x in base})
    labels = sorted({x[2] for x in (*base, *templates)})
    starts = [x[0] for x in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), len(covered) / max(1, len(words)))


def scan(docs: DataFrame) -> DataFrame:
    """Words, base phrases and labels of each row's text.

    ``score`` is the share of words inside a phrase or an accepted template. A
    null text has no words; every row is scanned by itself, so repeated rows and
    rows that share a ``doc_id``, which may be null, each give a row; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [_row(t) for t in pc.cast(as_text(batch.column("text")), pa.large_binary()).to_pylist()]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = [x.split()[0] for x in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)
