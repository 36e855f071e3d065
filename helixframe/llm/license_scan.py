"""License scans by template-markup matching.

Templates are license wording with markup: <<optional>> ... <</optional>> may be left out, <<var:m:n>>
stands for m to n words of any kind, <<one:a|b>> for one of the words. A template is compiled to a token
automaton; a place of a text matches if the automaton accepts from there, that is if every mandatory word
stands exactly as written. Automata are only started where the template's anchor, a run of mandatory
words, occurs, which the scan tests on the whole word sequence first. Every document is one row in, one
row out: no shuffle, and nothing grows with the corpus.

The templates are the usual notices, the short licenses to the end of their disclaimers, and the full texts in the
folder `licenses`, up to the end of their terms; `read_templates` reads further full texts from a folder.

Words are maximal runs of ASCII letters, digits and code points beyond ASCII, A-Z lower-cased; so case,
punctuation and line breaks never matter.

Base labels come from phrases that stand consecutively. Score: 1 if a template accepts. Else a template that runs on
from its anchor for a part of its wording and then departs gives PARTIAL times that part, and a base phrase gives 0.5; the
larger counts, and 0 if there is neither. A partial run never gives a label.

Defined cases: a null or empty text has no words; a very long text is scanned whole; overlapping places all count; where
a template fits in several ways the longest run from the first start counts; repeated rows give a row each, also with a
null id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table, text_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
PARTIAL, ANCHOR_WORDS = 0.75, 8

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording that several public licenses share.
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software"
_MIT_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:2:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var:0:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var:0:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_ADVERTISING = "<<var:0:1>> all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by <<var:1:16>>"
_BSD_NAMES = "<<var:0:1>> neither the name of <<var:1:14>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_WARRANTY = "this software is provided by <<var:1:10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:1:10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_CC = "<<optional>>licensed under<</optional>> <<optional>>the<</optional>> cc {kind} {version}"
_CC_LONG = "licensed under <<one:a|the>> creative commons attribution {kind} <<one:3|4>> 0 <<one:international|unported|generic>> license"
_GNU = "redistribute it and or modify it under the terms of the gnu {kind} general public license as published by the free software foundation either version {version} of the license or at your option any later version"
_GNU_WARRANTY = "<<one:this|the>> <<var:1:4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} general public license for more details"

# Label, anchor, wording. The wording is that of the public licenses and their usual notices.
TEMPLATES = [
    ("gpl-2.0", "gnu general public license", "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation either<</optional>> version 2"),
    ("gpl-3.0", "gnu general public license", "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation either<</optional>> version 3"),
    ("gpl-notice", "gnu general public license as published by", _GNU.format(kind="", version="<<one:1|2|3>> <<optional>>0<</optional>>")),
    ("gpl-warranty-notice", "see the gnu general public license for more details", _GNU_WARRANTY.format(kind="")),
    ("lgpl-notice", "gnu lesser general public license as published by", _GNU.format(kind="lesser", version="<<one:2|3>> <<optional>><<one:0|1>><</optional>>")),
    ("agpl-notice", "gnu affero general public license as published by", _GNU.format(kind="affero", version="3 <<optional>>0<</optional>>")),
    ("apache-2.0", "apache license", "licensed under the apache license <<optional>>version<</optional>> 2 0"),
    ("apache-2.0-header", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license <<optional>>you may obtain a copy of the license at <<one:http|https>> www apache org licenses license 2 0 <<optional>>txt<</optional>> <</optional>> <<optional>>unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license<</optional>>"),
    *((f"cc-by{k}-4.0", f"cc by {k.replace('-', ' ')} 4 0".replace("  ", " "), _CC.format(kind=f"by {k.replace('-', ' ')}", version="4 0")) for k in ("", "-nc", "-sa", "-nd", "-nc-sa", "-nc-nd")),
    *((f"cc-by{k}-notice", f"creative commons attribution {words}".strip(), _CC_LONG.format(kind=words)) for k, words in (("", ""), ("-sa", "sharealike"), ("-nc", "noncommercial"), ("-nd", "noderivatives"), ("-nc-sa", "noncommercial sharealike"), ("-nc-nd", "noncommercial noderivatives"))),
    ("mit-notice", "mit license", "<<one:released|licensed|distributed|available>> under the <<optional>>terms of the<</optional>> mit license"),
    ("mit-text", "permission is hereby granted free of charge", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("isc", "permission to use copy modify and", "permission to use copy modify and <<optional>>or<</optional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:1:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:1:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", "redistribution and use in source and binary forms", f"{_BSD_GRANT} {_BSD_WARRANTY}"),
    ("bsd-3-clause", "redistribution and use in source and binary forms", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("bsd-4-clause", "redistribution and use in source and binary forms", f"{_BSD_GRANT} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("zlib", "in no event will the authors be held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<var:0:1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<var:0:1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<var:0:1>> this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "boost software license version 1 0", "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mpl-2.0-notice", "subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<one:http|https>> mozilla org mpl 2 0"),
]


def read_templates(folder) -> list[tuple[str, str, str]]:
    """A template of each text file of a folder (a path, or a folder of a package): the label is the file's name, the anchor its first words before any markup."""
    found = []
    for path in sorted((Path(folder) if isinstance(folder, str) else folder).iterdir(), key=lambda p: p.name):
        if not path.name.endswith(".txt"):
            continue
        wording = path.read_text(encoding="utf-8")
        found.append((path.name.removesuffix(".txt"), " ".join(words_of(wording.split("<<")[0])[:ANCHOR_WORDS]), wording))
    return found


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


class Automaton:
    """A template as word edges: edges[state] holds (words or None for any, next state), free[state] the states reached without a word."""

    def __init__(self, wording: str):
        self.edges: list[list] = [[]]
        self.free: list[list[int]] = [[]]
        open_at: list[int] = []
        for part in re.findall(r"<<[^>]+>>|(?:(?!<<).)+", wording, re.DOTALL):
            if part == "<<optional>>":
                open_at.append(self._last())
            elif part == "<</optional>>":
                self.free[open_at.pop()].append(self._last())
            elif part.startswith("<<var:"):
                low, high = map(int, part[6:-2].split(":"))
                ends = []
                for i in range(high):
                    if i >= low:
                        ends.append(self._last())
                    self._word(None)
                for end in ends:
                    self.free[end].append(self._last())
            elif part.startswith("<<one:"):
                self._word(frozenset(part[6:-2].split("|")))
            else:
                for word in words_of(part):
                    self._word(frozenset([word]))
        if open_at:
            raise ValueError("an optional part is not closed")

    def _last(self) -> int:
        return len(self.edges) - 1

    def _word(self, words: frozenset | None) -> None:
        self.edges[-1].append((words, len(self.edges)))
        self.edges.append([])
        self.free.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, words: list[str], start: int) -> tuple[int | None, float]:
        """The end (exclusive) of the longest accepted run from start, None if there is none, and the part of the wording that was met."""
        states, best, furthest = self._closed({0}), None, 0
        for i in range(start, len(words) + 1):
            if self._last() in states:
                best = i
            if i == len(words) or not states:
                break
            w = words[i]
            states = self._closed({to for s in states for allowed, to in self.edges[s] if allowed is None or w in allowed})
            furthest = max(furthest, max(states, default=0))
        return best, furthest / max(1, self._last())

    def end_from(self, words: list[str], start: int) -> int | None:
        return self.run(words, start)[0]

    def longest(self) -> int:
        return len(self.edges)


@cache
def all_templates() -> tuple:
    """TEMPLATES and the full texts that come with the package."""
    return (*TEMPLATES, *read_templates(resources.files("helixframe.llm") / "licenses"))


@cache
def _compiled(templates: tuple) -> list[tuple[str, str, Automaton]]:
    return [(label, f" {anchor} ", Automaton(wording)) for label, anchor, wording in templates]


def _places(joined: str, phrase: str) -> list[int]:
    """Indices of the words where the phrase stands; joined and phrase have a space at either end."""
    out, at, seen, before = [], joined.find(phrase), 0, -1
    while at >= 0:
        before += joined.count(" ", seen, at + 1)
        seen = at + 1
        out.append(before)
        at = joined.find(phrase, at + 1)
    return out


def scan(text: str | None, templates: tuple | None = None) -> dict:
    """n_words, the base places (start, label), the template matches (label, start, end) and the largest part of a template that departs later."""
    words = words_of(text or "")
    joined = f" {' '.join(words)} "
    base = sorted((place, label) for phrase, label in PHRASES.items() for place in _places(joined, f" {phrase} "))
    matches, partial = [], 0.0
    for label, anchor, automaton in _compiled(templates or all_templates()):
        for place in _places(joined, anchor):
            for start in range(max(0, place - automaton.longest()), place + 1):
                end, part = automaton.run(words, start)
                if end is not None and end > place:
                    matches.append((label, start, end))
                    break
                if end is None:
                    partial = max(partial, part)
    return {"n_words": len(words), "base": base, "matches": sorted(set(matches), key=lambda m: (m[1], m[0])), "partial": partial}


def _scan_batches(batches: Iterator, templates: tuple | None) -> Iterator:
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = scan(text, templates)
            base, own = {label for _, label in found["base"]}, {m[0] for m in found["matches"]}
            starts = [at for at, _ in found["base"]]
            rows.append((found["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else max(0.5 if base else 0.0, PARTIAL * found["partial"])))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)


def scan_licenses(docs: DataFrame, templates: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    chosen = tuple(templates) if templates else None
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scan_batches(b, chosen), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of the whole `documents` table."""
    return scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
