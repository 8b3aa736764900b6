r"""License scans by template markup.

A template is the license's wording with two kinds of mark-up, as in the SPDX license list:

    <<beginOptional>> ... <<endOptional>>                   words that may be left out, nested or not
    <<var;name="holder";original="...";match=".{0,80}">>    words that may be replaced

Templates and texts become tokens: words in lower case, without punctuation, with spellings that
count as the same made equal. A template is compiled to an automaton over tokens: a mandatory word
is one transition, an optional part a way round it, a replaceable one a loop that takes tokens
whose original text the pattern accepts. A text holds a license where the automaton accepts a run
of its tokens, so mandatory wording has to be there word for word. Of the runs from one place the
longest counts; a match inside a longer one of another template doesn't.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quern.llm._bytes import trimmed
from quern.llm._io import table

WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*|©")
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "©": "copyright", "favour": "favor", "organisation": "organization", "noncommercial": "non-commercial", "sub-license": "sublicense", "sub-licence": "sublicense", "sublicence": "sublicense", "https": "http"}
WORK = '<<beginOptional>>This <<var;name="work";original="work";match=".{1,40}">> is <<endOptional>>'
COPYRIGHT = '<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="copyright";original="";match=".{0,200}">><<endOptional>>'
AS_IS = 'IN NO EVENT SHALL <<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,120}">> BE LIABLE FOR ANY'
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>>
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="provider";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,120}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{1,120}">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
        BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""


def gnu(license: str, version: str) -> str:
    return f"""This <<var;name="work";original="program";match=".{{1,40}}">> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the
        {license} as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> either version {version} of the License, or <<beginOptional>>(at your option)<<endOptional>> any later
        version"""


TEMPLATES: dict[str, str] = {
    "Apache-2.0": """<<beginOptional>>This <<var;name="work";original="work";match=".{1,40}">> is <<endOptional>>Licensed under the Apache License, Version 2.0
        <<beginOptional>>(the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0<<beginOptional>>Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.<<endOptional>><<endOptional>>""",
    "MIT-notice": """<<beginOptional>>This <<var;name="work";original="work";match=".{1,40}">> is <<endOptional>>Released under the MIT License""",
    "MIT": f"""<<beginOptional>>MIT License<<endOptional>> {COPYRIGHT} Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="software";original="this software and associated documentation files";match=".{{1,120}}">> (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. {AS_IS} CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "ISC": f"""<<beginOptional>>ISC License<<endOptional>> {COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<var;name="holder";original="THE AUTHOR";match=".{{1,80}}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var;name="holder2";original="THE AUTHOR";match=".{{1,80}}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE""",
    "0BSD": f"""<<beginOptional>>Zero-Clause BSD<<endOptional>> {COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{{1,80}}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder2";original="THE AUTHOR";match=".{{1,80}}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
        ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE""",
    "BSD-2-Clause": f"""{COPYRIGHT} {CLAUSES} {DISCLAIMER}""",
    "BSD-3-Clause": f"""{COPYRIGHT} {CLAUSES} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="owner";original="the copyright holder";match=".{{1,120}}">> nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. {DISCLAIMER}""",
    "Zlib": f"""{COPYRIGHT} This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
        in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
        software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
        OR OTHER DEALINGS IN THE SOFTWARE""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0""",
    "BSL-1.0-notice": """Distributed under the Boost Software License, Version 1.0<<beginOptional>>See accompanying file LICENSE_1_0.txt or copy at
        http://www.boost.org/LICENSE_1_0.txt<<endOptional>>""",
    "GPL-2.0-notice": gnu("GNU General Public License", "2"),
    "LGPL-2.1-notice": gnu("GNU Lesser General Public License", "2.1"),
    "GPL-3.0-standard-notice": gnu("GNU General Public License", "3"),
    "LGPL-3.0-notice": gnu("GNU Lesser General Public License", "3"),
    "AGPL-3.0-notice": gnu("GNU Affero General Public License", "3"),
    "CC-BY-4.0-notice": f"""{WORK} licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution 4.0 International
        <<beginOptional>>Public<<endOptional>> License""",
    "CC-BY-SA-4.0-notice": f"""{WORK} licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution-ShareAlike 4.0 International
        <<beginOptional>>Public<<endOptional>> License""",
    "GPL-3.0-notice": """<<beginOptional>>This <<var;name="work";original="work";match=".{1,40}">> is <<endOptional>>licensed under the GNU General Public License,
        <<beginOptional>>either<<endOptional>> version 3<<beginOptional>>of the License<<endOptional>><<beginOptional>>or any later version<<endOptional>>""",
    "CC-BY-NC-4.0": """<<beginOptional>>This <<var;name="work";original="work";match=".{1,40}">> is <<endOptional>>Licensed under
        <<beginOptional>>a Creative Commons license<<endOptional>> CC BY-NC 4.0""",
    "All-rights-reserved": f"""{COPYRIGHT} All rights reserved""",
    "SPDX-identifier": """SPDX-License-Identifier: <<var;name="id";original="MIT";match="[A-Za-z0-9.+-]+( (WITH|AND|OR) [A-Za-z0-9.+-]+)*">>""",
}


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of each token."""
    return [(SAME.get(w := m[0].lower(), w), m.start(), m.end()) for m in WORD.finditer(text)]


@dataclass
class Template:
    """An automaton: states with an operation each. ("word", w) takes that token, ("split", a, b)
    goes both ways, ("open", name, pattern, least, most) starts a replaceable part, ("any",) takes a token
    in it or ends it, ("accept",) accepts."""

    name: str
    program: list[tuple] = field(default_factory=list)
    mandatory: set[str] = field(default_factory=set)
    first: set[str] | None = None

    @property
    def anchor(self) -> str:
        return max(sorted(self.mandatory), key=len)


def bounds(pattern: str) -> tuple[re.Pattern | None, int, float]:
    """A replaceable part's pattern, None if any text of its length will do, and the least and most
    characters that it takes; most is infinite where the pattern sets no bound."""
    if m := re.fullmatch(r"\.(?:([*+?])|\{(\d+)(,?)(\d*)\})", pattern):
        if m[1]:
            return None, int(m[1] == "+"), 1 if m[1] == "?" else math.inf
        return None, int(m[2]), int(m[4]) if m[4] else math.inf if m[3] else int(m[2])
    return re.compile(pattern, re.S), 0, math.inf


MARK = re.compile(r'<<(beginOptional|endOptional|var)((?:;\w+="[^"]*")*)>>', re.S)


def compile_template(name: str, source: str) -> Template:
    """ValueError if the mark-up isn't balanced or nothing is mandatory."""
    t, stack, at = Template(name), [], 0

    def words(part: str) -> None:
        for w, _, _ in tokens(part):
            t.program.append(("word", w))
            if not stack:
                t.mandatory.add(w)

    for m in MARK.finditer(source):
        words(source[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append(len(t.program))
            t.program.append(None)
        elif m[1] == "endOptional":
            if not stack:
                raise ValueError(f"{name}: an optional part ends that didn't begin")
            k = stack.pop()
            t.program[k] = ("split", k + 1, len(t.program))
        else:
            args = dict(re.findall(r';(\w+)="([^"]*)"', m[2]))
            pattern = args.get("match", ".*")
            t.program.append(("open", args.get("name", ""), *bounds(pattern)))
            t.program.append(("any",))
    words(source[at:])
    if stack or not t.mandatory:
        raise ValueError(f"{name}: " + ("an optional part doesn't end" if stack else "nothing is mandatory"))
    t.program.append(("accept",))
    starts, seen, todo = set(), set(), [0]
    while todo:
        k = todo.pop()
        if k in seen:
            continue
        seen.add(k)
        op = t.program[k]
        if op[0] == "word":
            starts.add(op[1])
        elif op[0] == "split":
            todo += op[1:]
        else:
            starts = None
            break
    t.first = starts
    return t


def accept(t: Template, toks: list[tuple[str, int, int]], text: str, at: int) -> tuple[int, list[tuple[str, int, int]]] | None:
    """The token after the longest accepted run from at, and the replaced parts in it as
    (name, start, end) of the text; None if no run is accepted. Of ways with equal ends the one
    that takes optional parts counts."""
    best = None
    # A thread: state, first token of the open replaceable part (or -1), parts so far.
    threads, seen = [(0, -1, ())], set()
    pos = at
    while threads:
        after, seen = [], set()
        stack = threads[::-1]
        while stack:
            k, begun, parts = stack.pop()
            if (k, begun) in seen:
                continue
            seen.add((k, begun))
            op = t.program[k]
            if op[0] == "accept":
                best = (pos, parts) if best is None or pos > best[0] else best
            elif op[0] == "split":
                stack += [(op[2], -1, parts), (op[1], -1, parts)]
            elif op[0] == "open":
                stack.append((k + 1, pos, parts))
            elif op[0] == "any":
                _, name, pattern, least, most = t.program[k - 1]
                a, z = (toks[begun][1], toks[pos - 1][2]) if pos > begun else (0, 0)
                if least <= z - a <= most and (pattern is None or pattern.fullmatch(text, a, z)):
                    stack.append((k + 1, -1, (*parts, (name, a, z)) if z else parts))
                if pos < len(toks) and z - a <= most:
                    after.append((k, begun, parts))
            elif pos < len(toks) and toks[pos][0] == op[1]:
                after.append((k + 1, -1, parts))
        threads, pos = after, pos + 1
    return best and (best[0], list(best[1]))


def scan(text: str, templates: list[Template]) -> list[dict]:
    """Matches in a text, by place: license, start, end and the replaced parts."""
    toks = tokens(text)
    where: dict[str, list[int]] = {}
    for i, (w, _, _) in enumerate(toks):
        where.setdefault(w, []).append(i)
    found = []
    for t in templates:
        if not t.mandatory <= where.keys():
            continue
        at = 0
        for i in sorted({i for w in t.first for i in where.get(w, ())}) if t.first is not None else range(len(toks)):
            if i >= at and (hit := accept(t, toks, text, i)):
                at = hit[0]
                found.append({"license": t.name, "start": toks[i][1], "end": toks[at - 1][2], "parts": [{"name": n, "start": a, "end": z} for n, a, z in hit[1]]})
    out, reach, span = [], -1, None
    for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
        if (f["start"], f["end"]) != span:
            span, reach, before = (f["start"], f["end"]), max(reach, f["end"]), reach
        if f["end"] > before:  # else it lies in a longer one that began no later
            out.append(f)
    return sorted(out, key=lambda f: (f["start"], f["license"]))


PARTS = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scanner(sources: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [compile_template(n, s) for n, s in sources.items()]
        spelled = {v: [v] for t in templates for v in (t.anchor,)}
        for k, v in SAME.items():
            if v in spelled:
                spelled[v].append(k)
        some = "|".join(re.escape(w) for w in sorted({w for ws in spelled.values() for w in ws})) or "$^"
        for b in batches:
            ids, text = b.column("doc_id"), b.column("text")
            rows = [(i, f) for i, x in enumerate(pc.match_substring_regex(text, some, ignore_case=True).to_pylist()) if x for f in scan(text[i].as_py(), templates)]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([f["license"] for _, f in rows], pa.string()), pa.array([f["start"] for _, f in rows], pa.int32()), pa.array([f["end"] for _, f in rows], pa.int32()), pa.array([f["parts"] for _, f in rows], PARTS)], names=["doc_id", "license", "start", "end", "parts"])

    return trimmed(run)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start, end, parts) of each match in each row of docs: characters of the
    text, and the (name, start, end) of replaced parts.

    Row by row and without a shuffle: repeated rows and null ids give their matches each time; null
    and empty texts give none, and so does an empty table. No templates match nothing. Other
    columns don't matter. Ids may have any type. A text's time grows with its tokens, those of
    templates whose replaceable parts have no bound apart: each of their places reads on to the end.
    """
    held = TEMPLATES if templates is None else templates
    for n, s in held.items():
        compile_template(n, s)
    return docs.select("doc_id", "text").mapInArrow(_scanner(dict(held)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, start int, end int, parts array<struct<name:string,start:int,end:int>>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
