import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.llm import licenses


def slow(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(label, i) for i in range(len(words)) for phrase, label in licenses.PHRASES if tuple(words[i : i + len(phrase)]) == phrase]
    return len(words), places


PARTS = ["MIT", "License", "license", "licences", "Apache", "General", "Public", "GENERAL", "é", "ſ", " ", "  ", "-", "\n", ".", "x", "3"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=24).map("".join))
def test_base_by_brute_force(text):
    seen = licenses.analysed(text)
    assert (seen["n_words"], [(label, start) for label, start, _ in seen["phrases"]]) == slow(text)


def enumerated(template):
    """All texts of a template in which any word is spelled `any`."""
    tokens = re.findall(r"\[[^\]]*\]|<\d+>|[^\s\[\]<>]+", template)
    texts = [[]]
    for t in tokens:
        if t[0] == "[":
            texts = [x + more for x in texts for more in ([], t[1:-1].split())]
        elif t[0] == "<":
            texts = [x + ["any"] * n for x in texts for n in range(int(t[1:-1]) + 1)]
        else:
            texts = [x + [t] for x in texts]
    return texts


def test_automata_by_enumeration():
    template = "[a b] c <2> d [e] f"
    machine = licenses.Automata((("t", template),))
    good = enumerated(template)
    assert all(("t", 0, len(t)) in machine.matches(t) for t in good)
    for t in good:
        for k in range(len(t)):
            changed = t[:k] + ["wrong"] + t[k + 1 :]
            whole = [m for m in machine.matches(changed) if m[1:] == (0, len(t))]
            assert not whole or t[k] == "any" or changed.count("wrong") == 1 and t[k] == "any"


def test_labels(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    texts = [mit, "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "the apache license board met", "nothing here", mit.replace("free of charge", "at a charge")]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert [got[k]["labels"] for k in range(8)] == ["mit", "mit", "gpl,gpl-3.0", "apache,apache-2.0", "cc-by-nc-4.0", "apache", "", "mit"]
    assert [got[k]["score"] for k in range(8)] == [1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 0.0, 0.5]
    assert (got[5]["first_word"], got[5]["last_word"], got[6]["first_word"]) == (1, 1, None)


def test_awkward_rows(docs, no_docs):
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count() and all(r["labels"] == "" and r["score"] == 0 for r in got)
    assert licenses.scan(no_docs).count() == 0


def test_wording_may_be_broken_anywhere_and_templates_may_be_ones_own():
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby\ngranted, provided that the above copyright notice and this permission notice appear in all copies."
    assert [m[0] for m in licenses.analysed(isc)["templates"]] == ["isc"]
    own = (("own", "free as <3> in beer [or not]"),)
    assert licenses.analysed("Free -- as they say: in beer, or not!", own)["templates"] == [("own", 0, 8)]
    assert licenses.analysed("free in beer", own)["templates"] == []


NOTICES = {
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-2.1": "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "agpl-3.0": "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed",
    "epl-2.0": "materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "spdx-bsd-3-clause": "// SPDX-License-Identifier: BSD-3-Clause",
    "apache-2.0": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n1. Definitions.\n\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.\n\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "lgpl-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented",
}


def test_notices_and_headings():
    for label, text in NOTICES.items():
        _, start, end = next(found for found in licenses.analysed(text)["templates"] if found[0] == label)
        words = licenses.WORD.findall(text.lower())
        without = " ".join(w for k, w in enumerate(words) if k != (start + end) // 2)  # a mandatory word is missing
        assert label not in {found for found, _, _ in licenses.analysed(without)["templates"]}, label
