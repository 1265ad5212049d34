import re

import pytest

from lexlake.llm import licenses as L

from .conftest import EDGES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(parts)] == parts:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def expand(markup):
    """A regular expression over space-joined words that means the same as the markup."""
    out, depth = [], 0
    for k, part in enumerate(re.split("<<(.*?)>>", markup)):
        if k % 2 == 0:
            out += [re.escape(w) + " " for w in WORD.findall(part.translate(LOWER))]
        elif part == "beginOptional":
            out.append("(?:")
            depth += 1
        elif part == "endOptional":
            out.append(")?")
            depth -= 1
        else:
            out.append("(?:[^ ]+ ){0,%s}" % re.search(r"max=(\d+)", part)[1])
    return re.compile("(?<![^ ])" + "".join(out))


def accepted(text):
    flat = " ".join(WORD.findall((text or "").translate(LOWER))) + " "
    return {label for label, markup in L.TEMPLATES if expand(markup).search(flat)}


def check(found, rows):
    want = []
    for doc_id, text in rows:
        own = base(text)
        want.append((str(doc_id), *map(str, own), ",".join(sorted({*filter(None, own[4].split(",")), *accepted(text)}))))
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))) for r in found) == sorted(want)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_edges(edge_docs, no_docs):
    check(L.scan_licenses(edge_docs).collect(), [(r[0], r[1]) for r in EDGES])
    assert L.scan_licenses(no_docs).collect() == []


def test_documents(docs):
    check(L.scan_licenses(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


MIT = """Copyright (c) 2020 A. Body. Permission is hereby granted, free of charge, to any person obtaining a copy of this {0} and associated documentation files (the "{1}"), to deal in the {1} without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the {1}, and to permit persons to whom the {1} is furnished to do so, {2}subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the {1}. THE {1} IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE {1} OR THE USE OR OTHER DEALINGS IN THE {1}."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
GRANT = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("x Licensed under CC BY-NC 4.0. y", {"cc-by", "cc-by-nc-4.0"}), ("cc by cc by", {"cc-by"}), ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("Licensed under the Apache License, Version 2.1", set()), ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        ("licensed under the gnu general public license as published by the free software foundation version 3", {"gpl", "gpl-3.0"}), (MIT.format("software", "Software", ""), {"mit"}),
        (MIT.format("fine tool", "Tool", "").upper(), {"mit"}), (MIT.format("one two three", "a", ""), set()), (MIT.format("software", "Software", "at a price "), set()), (MIT.format("software", "Software", "")[:300], set()),
        (BSD.format(""), {"bsd-2-clause"}), (BSD.format(NAMES), {"bsd-3-clause"}), (BSD.format("3. No use on Sundays.\n"), set()), (BSD.format("").replace("must reproduce", "need not reproduce"), set()),
        (GRANT.format("General Public License", "2"), {"gpl", "gpl-2.0-or-later"}), (GRANT.format("General Public License", "3"), {"gpl", "gpl-3.0-or-later"}),
        (GRANT.format("Lesser General Public License", "2.1"), {"gpl", "lgpl-2.1-or-later"}), (GRANT.format("Affero General Public License", "3"), {"gpl", "agpl-3.0-or-later"}),
        ("Copyright (c) 2020 Some Body Ltd. All rights reserved.", {"reserved"}), ("all rights not reserved", set()), ("licensed under " * 3000 + "the mit license", {"mit"}),
    ],
)
def test_templates(text, labels):
    own = tuple((label, phrase) for phrase, label in L.PHRASES.items())
    assert set(L.scan(text, own, L.TEMPLATES)[5]) == labels == accepted(text) | {x for x in base(text)[4].split(",") if x}


def test_score_of_altered_terms():
    score = lambda text: L.scan(text, (), L.TEMPLATES)[6]
    whole = MIT.format("software", "Software", "")
    assert score(whole) == 1 and score("nothing of the kind") == 0
    assert 0.35 < score(MIT.format("software", "Software", "at a price ")) < 0.6 and 0.9 < score(whole.replace("OTHER DEALINGS", "ANY DEALINGS")) < 1


def test_every_template_accepts_its_own_wording():
    for label, markup in L.TEMPLATES:
        bare = re.sub("<<.*?>>", " ", markup)
        assert L.Automaton.compile(label, markup).match(L.words(bare), 0)[0], label
