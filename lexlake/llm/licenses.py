"""License scans by template markup.

A template is wording with optional and replaceable regions, marked as in public license lists:
<<beginOptional>> ... <<endOptional>> and <<var;max=N>> (up to N words of any kind). It is compiled into an automaton over words;
a stretch of a text is accepted when all mandatory wording stands there exactly, in order, with only the marked regions free.
Licenses stand with the whole of their terms, so that altered terms are not accepted, and variants are told apart; short notices that name
a license are templates of their own.

A template's anchor is the beginning of its mandatory wording, or of its longest run of mandatory words where it begins with fewer
than three. Only texts that hold an anchor are walked word by word, from each word that can begin a template.

Phrases of the base are found the same way, at every place where their words stand consecutively; labels of templates come on top.
score is the largest share of a template's mandatory words that one attempt matched in order, in texts that hold its anchor: 1 for an
accepted template or phrase, 0 for a text without anchors.

Defined results: a null or wordless text has no words, no labels and score 0; repeated rows are scanned each; a text of any length
is walked in time proportional to its length times the bounded length of a match; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Phrase and label of the base (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of well-known licenses and notices; case and punctuation don't count.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var;max=2>> and associated documentation files (the <<var;max=2>>), to deal in the <<var;max=2>>
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the <<var;max=2>>, and to permit persons to whom
the <<var;max=2>> is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
included in all copies or substantial portions of the <<var;max=2>>. """
_MIT_WARRANTY = """THE <<var;max=2>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
<<var;max=2>> OR THE USE OR OTHER DEALINGS IN THE <<var;max=2>>"""
_ISC = """Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;max=1>> Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. <<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = "<<var;max=1>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var;max=1>> The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;max=1>>
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;max=1>> This notice may not be removed or altered from any source distribution"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law. """
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"""
_GNU_GRANT = """This <<var;max=4>> is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or
<<beginOptional>>(at your option)<<endOptional>> any later version"""

#: Label and wording of licenses and notices.
TEMPLATES = (
    ("mit", _MIT + _MIT_WARRANTY),
    ("isc", _ISC),
    ("bsd-2-clause", _BSD + _BSD_WARRANTY),
    ("bsd-3-clause", _BSD + _BSD_NAMES + _BSD_WARRANTY),
    ("zlib", _ZLIB),
    ("unlicense", _UNLICENSE + _MIT_WARRANTY),
    ("apache-2.0", _APACHE_NOTICE),
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("apache-2.0", "licensed under the Apache License <<beginOptional>>,<<endOptional>> version 2.0"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-SA 4.0"),
    ("gpl-3.0", "<<beginOptional>>this <<var;max=3>> is<<endOptional>> licensed under the GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 3"),
    ("gpl-2.0-or-later", _GNU_GRANT.format(name="General Public License", version="2")),
    ("gpl-3.0-or-later", _GNU_GRANT.format(name="General Public License", version="3")),
    ("lgpl-2.1-or-later", _GNU_GRANT.format(name="Lesser General Public License", version="2.1")),
    ("lgpl-3.0-or-later", _GNU_GRANT.format(name="Lesser General Public License", version="3")),
    ("agpl-3.0-or-later", _GNU_GRANT.format(name="Affero General Public License", version="3")),
    ("mpl-2.0", "this source code form is subject to the terms of the Mozilla Public License, <<beginOptional>>version<<endOptional>> <<beginOptional>>v.<<endOptional>> 2.0. If a copy of the MPL was not distributed with this file, <<beginOptional>>You can obtain one at <<var;max=8>><<endOptional>>"),
    ("cc0-1.0", "to the extent possible under law, <<var;max=12>> has waived all copyright and related or neighboring rights to <<var;max=6>>"),
    ("reserved", "copyright <<beginOptional>>c<<endOptional>> <<var;max=12>> all rights reserved"),
)

#: Words of the anchor of a template.
_ANCHOR_WORDS = 4
_WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))
_MARK = re.compile(r"<<(.*?)>>")


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().lower().translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """States are numbered; state 0 is the start. on: word moves; any: moves on every word; free: moves on none."""

    label: str
    on: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[int] = field(default_factory=lambda: [-1])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    passed: list[int] = field(default_factory=lambda: [0])  # mandatory words before the state
    mandatory: int = 0
    anchor: bytes = b""
    final: int = 0

    def _state(self) -> int:
        for column, empty in ((self.on, {}), (self.any, -1), (self.free, []), (self.passed, self.mandatory)):
            column.append(empty)
        return len(self.on) - 1

    @classmethod
    def compile(cls, label: str, markup: str) -> Automaton:
        made = cls(label)
        now, optional, run, runs = 0, [], [], []
        for k, part in enumerate(_MARK.split(markup)):
            if k % 2 == 0:
                for word in words(part):
                    if not optional:
                        made.mandatory += 1
                        run.append(word)
                    after = made._state()
                    made.on[now][word] = after
                    now = after
                continue
            runs.append(run)
            run = []
            if part == "beginOptional":
                optional.append(now)
                after = made._state()
                made.free[now].append(after)
                now = after
            elif part == "endOptional":
                after = made._state()
                made.free[now].append(after)
                made.free[optional.pop()].append(after)
                now = after
            else:
                most = int(re.search(r"max=(\d+)", part)[1])
                before = [now]
                for _ in range(most):
                    after = made._state()
                    made.any[now] = after
                    before.append(after)
                    now = after
                after = made._state()
                for state in before:
                    made.free[state].append(after)
                now = after
        runs.append(run)
        made.final = now
        opening = next((r for r in runs if r), [])
        anchor = opening if len(opening) >= min(3, made.mandatory) else max(runs, key=len)
        made.anchor = b" " + b" ".join(anchor[:_ANCHOR_WORDS]) + b" "
        return made

    def close(self, states: set[int]) -> set[int]:
        stack = list(states)
        while stack:
            for after in self.free[stack.pop()]:
                if after not in states:
                    states.add(after)
                    stack.append(after)
        return states

    def first(self) -> set[bytes]:
        """Words that can begin a match: a region that may begin one is taken up at its first fixed word."""
        return {w for s in self.close({0}) for w in self.on[s]}

    def match(self, text: list[bytes], at: int) -> tuple[bool, int]:
        """(accepted from `at`, most mandatory words passed)."""
        states, best = self.close({0}), 0
        for k in range(at, len(text)):
            word = text[k]
            after = {t for s in states if (t := self.on[s].get(word, -1)) >= 0} | {t for s in states if (t := self.any[s]) >= 0}
            if not after:
                break
            states = self.close(after)
            best = max(best, *(self.passed[s] for s in states))
            if self.final in states:
                return True, self.mandatory
        return False, best


@lru_cache(maxsize=8)
def automata(templates: tuple[tuple[str, str], ...]) -> list[Automaton]:
    return [Automaton.compile(label, markup) for label, markup in templates]


def scan(text: str | None, phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score of one text."""
    found = words(text)
    flat = b" " + b" ".join(found) + b" "
    places, base, labels, score = [], set(), set(), 0.0
    for known in automata(phrases):
        if known.anchor in flat:
            part = [w for words_ in known.on for w in words_]
            hits = [k for k, w in enumerate(found) if w == part[0] and found[k : k + len(part)] == part]
            places += hits
            base.add(known.label)
            score = 1.0
    for known in automata(templates):
        if known.anchor in flat:
            first = known.first()
            for k, w in enumerate(found):
                if w in first:
                    accepted, passed = known.match(found, k)
                    score = max(score, passed / known.mandatory)
                    if accepted:
                        labels.add(known.label)
                        break
    return len(found), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(base | labels), score


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    own = tuple((label, phrase) for phrase, label in phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py(), own, templates) for x in batch.column(1)]
            n_words, n_base, first, last, base, labels, score = zip(*rows, strict=True) if rows else ((),) * 7
            columns = [pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)]
            joined = [pa.array([",".join(x) for x in c], pa.string()) for c in (base, labels)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *joined, pa.array(score, pa.float64())], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.read(spark, sf_dir, "documents"))


QUERIES = {"op4_license_templates": op4_license_templates}
#: Templates have no SQL counterpart; tests/llm compares with brute force.
SQL: dict[str, str] = {}
