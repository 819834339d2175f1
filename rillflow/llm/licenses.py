"""License scan: fixed phrases, and license texts recognised by automata compiled from marked-up templates.

A template is a line of words with two kinds of markup: `[ ... ]` encloses words that may be left out, and `<n>` stands
for up to n words of any kind (a holder's name, a year). Everything else is mandatory and must match word for word.

Null and empty texts have no words and no labels; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import map_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <8> be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
    "out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met [1] redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution"
)
_COPIES = "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"
_FSF = "free software foundation inc"
_TERMS = "redistribute it and or modify it under the terms of the gnu"
_BY_FSF = "as published by the free software foundation"
#: The wording of well-known licenses and of the notices that refer to them. Of the longest licenses the
#: mandatory wording is that of their heading and first paragraphs.
TEMPLATES = (
    ("mit", "[this work is] [released] [licensed] under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice [including the next paragraph] shall be included in all copies or substantial "
        "portions of the software " + _WARRANTY,
    ),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license [as published by the free software foundation] [either] version 3"),
    ("gpl-2.0", "licensed under the gnu general public license [as published by the free software foundation] [either] version 2"),
    ("lgpl", "licensed under the gnu lesser general public license <4> version"),
    ("agpl-3.0", "licensed under the gnu affero general public license [as published by the free software foundation] [either] version 3"),
    ("cc-by-4.0", "licensed under [a] [the] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [a] [the] cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under [a] [the] cc by nc 4 0"),
    ("cc-by-4.0", "licensed under [a] [the] creative commons attribution 4 0 international license"),
    ("cc0-1.0", "[released] [dedicated] [to] [the] [public] [domain] under cc0 1 0"),
    ("bsd-2-clause", _BSD + " this software is provided by <12> as is"),
    ("bsd-3-clause", _BSD + " [3] neither the name of <12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "apache-2.0",
        "apache license version 2 0 january 2004 <6> terms and conditions for use reproduction and distribution 1 definitions "
        "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 "
        "of this document licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting "
        "the license",
    ),
    ("gpl-3.0", f"gnu general public license version 3 29 june 2007 copyright <1> 2007 {_FSF} <5> {_COPIES} [preamble] the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", f"gnu general public license version 2 june 1991 copyright <1> 1989 1991 {_FSF} <14> {_COPIES} [preamble] the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl-2.1", f"gnu lesser general public license version 2 1 february 1999 copyright <1> 1991 1999 {_FSF} <14> {_COPIES}"),
    ("lgpl-3.0", f"gnu lesser general public license version 3 29 june 2007 copyright <1> 2007 {_FSF} <5> {_COPIES} this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", f"gnu affero general public license version 3 19 november 2007 copyright <1> 2007 {_FSF} <5> {_COPIES} [preamble] the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", f"{_TERMS} general public license {_BY_FSF} [either] version 3"),
    ("gpl-2.0", f"{_TERMS} general public license {_BY_FSF} [either] version 2"),
    ("gpl-2.0", f"under the terms of the gnu general public license version 2 [only] {_BY_FSF}"),
    ("lgpl-2.1", f"{_TERMS} lesser general public license {_BY_FSF} [either] version 2 1"),
    ("lgpl-3.0", f"{_TERMS} lesser general public license {_BY_FSF} [either] version 3"),
    ("agpl-3.0", f"{_TERMS} affero general public license {_BY_FSF} [either] version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software"),
    ("epl-2.0", "made available under the terms of the eclipse public license [v] [version] 2 0"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the <4> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache-2.0", "spdx license identifier apache 2 0"),
    ("spdx-gpl-2.0", "spdx license identifier gpl 2 0"),
    ("spdx-gpl-3.0", "spdx license identifier gpl 3 0"),
    ("spdx-lgpl-2.1", "spdx license identifier lgpl 2 1"),
    ("spdx-lgpl-3.0", "spdx license identifier lgpl 3 0"),
    ("spdx-agpl-3.0", "spdx license identifier agpl 3 0"),
    ("spdx-mpl-2.0", "spdx license identifier mpl 2 0"),
    ("spdx-epl-2.0", "spdx license identifier epl 2 0"),
    ("spdx-bsl-1.0", "spdx license identifier bsl 1 0"),
    ("spdx-bsd-2-clause", "spdx license identifier bsd 2 clause"),
    ("spdx-bsd-3-clause", "spdx license identifier bsd 3 clause"),
    ("spdx-isc", "spdx license identifier isc"),
    ("spdx-zlib", "spdx license identifier zlib"),
)


def compiled(template: str) -> tuple[list[dict[str | None, list[int]]], list[list[int]], int]:
    """Automaton of a template: by state the moves on a word (None: any word) and the free moves; the accepting state."""
    moves: list[dict[str | None, list[int]]] = [{}]
    free: list[list[int]] = [[]]

    def state() -> int:
        moves.append({})
        free.append([])
        return len(moves) - 1

    opened, at = [], 0
    for part in re.findall(r"\[|\]|<\d+>|[^\s\[\]<>]+", template):
        if part == "[":
            opened.append(at)
        elif part == "]":
            free[opened.pop()].append(at)
        elif part[0] == "<":
            first = at
            for _ in range(int(part[1:-1])):
                free[at].append(new := state())
                moves[at].setdefault(None, []).append(new)
                at = new
            free[first].append(at)
        else:
            moves[at].setdefault(part, []).append(new := state())
            at = new
    return moves, free, at


class Automata:
    """All templates at once; a start costs only as many steps as words agree."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.parts = [(label, *compiled(text)) for label, text in templates]
        # A text with none of these words holds neither a phrase nor the whole mandatory wording of any template.
        self.hints = {"license"}
        for _, text in templates:
            mandatory = re.sub(r"\[[^\]]*\]|<\d+>", " ", text).split()
            if not any(hint in word for hint in self.hints for word in mandatory):
                self.hints.add(max(mandatory, key=lambda w: (any(map(str.isdigit, w)) and not w.isdigit(), len(w))))
        self.starts: dict[str, list[tuple[int, set[int]]]] = {}
        for k, (_, moves, free, _) in enumerate(self.parts):
            reach = self.closure({0}, free)
            for word in {w for s in reach for w in moves[s] if w is not None}:
                self.starts.setdefault(word, []).append((k, reach))

    @staticmethod
    def closure(states: set[int], free: list[list[int]]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    def matches(self, words: list[str]) -> list[tuple[str, int, int]]:
        """(label, start, end) of the longest accepted run from each start."""
        found = []
        for start, word in enumerate(words):
            for k, reach in self.starts.get(word, ()):
                label, moves, free, last = self.parts[k]
                states, at, best = reach, start, 0
                while states and at < len(words):
                    ahead = {n for s in states for w in (words[at], None) for n in moves[s].get(w, ())}
                    states, at = self.closure(ahead, free), at + 1
                    if last in states:
                        best = at
                if best:
                    found.append((label, start, best))
        return found


@lru_cache(maxsize=8)
def automata(templates: tuple[tuple[str, str], ...]) -> Automata:
    return Automata(templates)


def analysed(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> dict:
    """Words, phrase places and accepted templates of one whole text."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    words = WORD.findall(low)
    machine = automata(templates)
    if not any(hint in low for hint in machine.hints):
        return {"n_words": len(words), "phrases": [], "templates": []}
    phrases = []
    for at, word in enumerate(words):
        if word in ("mit", "apache", "general"):
            phrases += [(label, at, at + len(p)) for p, label in PHRASES if words[at : at + len(p)] == list(p)]
    return {"n_words": len(words), "phrases": phrases, "templates": machine.matches(words)}


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, matches, score.

    score is 1 where a template accepts, 1 - 2**-n_base where only phrases stand, else 0. matches lists label:start:end
    of the accepted templates. A narrow pass over whole texts; nothing is shuffled.
    """

    def per_batch(batch: pa.RecordBatch) -> list:
        columns: list[list] = [batch.column(0), *([] for _ in range(8))]
        for text in batch.column(1).to_pylist():
            seen = analysed(text, templates)
            starts = [start for _, start, _ in seen["phrases"]]
            base = {label for label, _, _ in seen["phrases"]}
            accepted = seen["templates"]
            values = (
                seen["n_words"],
                len(starts),
                min(starts, default=None),
                max(starts, default=None),
                ",".join(sorted(base)),
                ",".join(sorted(base | {label for label, _, _ in accepted})),
                ",".join(f"{label}:{start}:{end}" for label, start, end in accepted),
                1.0 if accepted else 1.0 - 0.5 ** len(starts),
            )
            for column, value in zip(columns[1:], values, strict=True):
                column.append(value)
        return columns

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, matches string, score double"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, per_batch)
