"""License scans by template markup.

A template is a license's wording with ``<<beginOptional>> ... <<endOptional>>`` around what may be missing and
``<<var;name=...;words=a-b>>`` for what may be replaced, by a to b words.  It is compiled to an automaton over words, in which
optional regions can be passed over and replaceable ones take any word.  A text is accepted from each place where the
template's opening words stand if the automaton ends: all mandatory words are there, in order and unchanged.

Base labels stand for phrases, wherever their words are consecutive.  Words are A-Z lower-cased runs of letters, digits and
non-ASCII characters.  Null texts have no words and no labels; the longest acceptance counts where several end; repeated rows
and other columns change nothing; every text is judged alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded
from .lines import NOT_WORD
from .wordhash import chunks, split, windows

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<var;name=name;words=1-3>>), to deal in the "
        "<<var;name=name;words=1-3>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "<<var;name=name;words=1-3>>, and to permit persons to whom the <<var;name=name;words=1-3>> is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the <<var;name=name;words=1-3>>. THE <<var;name=name;words=1-3>> IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL <<var;name=holder;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "<<var;name=name;words=1-3>> OR THE USE OR OTHER DEALINGS IN THE <<var;name=name;words=1-3>>")
_BULLET = "<<beginOptional>><<var;name=bullet;words=1-1>><<endOptional>> "
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        f"{_BULLET}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        f"{_BULLET}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. ")
_BSD_NAMES = f"{_BULLET}Neither the name of <<var;name=holder;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1-12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
            "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name=holder;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
            "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
            "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")

#: Public notices and whole wordings (mit-grant-notice and bsd-notice: a license's opening alone), with their optional and replaceable
#: regions.  Each opens with two mandatory words or more.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file except in compliance with the License. "
                  "You may obtain a copy of the License at <<var;name=url;words=1-8>> <<endOptional>>",
    "mit": "Released under the MIT <<beginOptional>>open source<<endOptional>> License",
    "mit-grant-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<var;name=name;words=1-3>>), to deal in the "
                 "<<var;name=name;words=1-3>> without restriction",
    "mit-text": _MIT,
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_NAMES + _BSD_END,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
           "THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;name=holder;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
           "<<var;name=holder;words=1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
           "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;name=holder;words=1-4>> be held liable for any damages arising from the use of this software. "
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
            f"{_BULLET}The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
            f"would be appreciated but is not required. {_BULLET}Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
            f"{_BULLET}This notice may not be removed or altered from any source distribution",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                         "<<var;name=url;words=1-8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
                         "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    "gpl-3.0": "licensed under the GNU General Public License<<beginOptional>>,<<endOptional>> version 3 <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>",
    "lgpl": "under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License <<beginOptional>>version <<var;name=version;words=1-2>><<endOptional>>",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0": "Licensed under <<beginOptional>>the <<endOptional>><<beginOptional>>Creative Commons <<endOptional>>CC BY-NC 4.0 <<beginOptional>>International<<endOptional>>",
    "cc-by-sa": "Licensed under <<beginOptional>>the <<endOptional>>CC BY-SA <<var;name=version;words=2-2>>",
    "all-rights-reserved": "Copyright <<var;name=holder;words=1-12>> All rights reserved",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate({k: k + 32 for k in range(65, 91)}))


@dataclass
class Automaton:
    """States 0 .. n; ``step``: word, or None for any word, to the next state; ``skip``: states reached without a word."""

    label: str
    step: list[str | None] = field(default_factory=list)
    skip: dict[int, set[int]] = field(default_factory=dict)

    @staticmethod
    def compile(label: str, template: str) -> Automaton:
        out = Automaton(label)
        opened: list[int] = []
        at = 0
        for mark in [*_MARK.finditer(template), None]:
            out.step += words_of(template[at : mark.start() if mark else len(template)])
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "beginOptional":
                opened.append(len(out.step))
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError(f"{label}: endOptional without a beginning")
                out.skip.setdefault(opened.pop(), set()).add(len(out.step))
            else:
                least, most = map(int, re.search(r"words=(\d+)-(\d+)", mark[1]).groups())
                out.step += [None] * least
                for _ in range(most - least):
                    out.skip.setdefault(len(out.step), set()).add(len(out.step) + 1)
                    out.step.append(None)
        if opened:
            raise ValueError(f"{label}: beginOptional without an end")
        return out

    @property
    def opening(self) -> list[str]:
        """The mandatory words that it begins with."""
        out: list[str] = []
        for k, word in enumerate(self.step):
            if word is None or k in self.skip:
                break
            out.append(word)
        return out

    def _reach(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for to in self.skip.get(todo.pop(), ()):
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def accept(self, words: Iterator[bytes]) -> tuple[int, int] | None:
        """Words of the longest acceptance from here, and how many of them are the template's own; None: not accepted."""
        end, best, count = len(self.step), None, 0
        states = dict.fromkeys(self._reach({0}), 0)
        for word in words:
            text = word.decode("utf-8", "replace")
            after: dict[int, int] = {}
            for s, own in states.items():
                if s < end and (self.step[s] is None or self.step[s] == text):
                    gained = own + (self.step[s] is not None)
                    for to in self._reach({s + 1}):
                        after[to] = max(after.get(to, -1), gained)
            if not after:
                break
            states, count = after, count + 1
            if end in states:
                best = count, states[end]
        return best


def _hash(words: list[str]) -> np.uint64:
    w = split(pa.array([" ".join(words)]), lower=True, separator=NOT_WORD)
    return windows(w.hash, len(words))[0]


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:int,words:int>>"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches of every row.

    score: the largest share that an acceptance holds of its template's words (optional ones too); one half for a base
    phrase alone, else 0.
    """
    machines = [Automaton.compile(label, text) for label, text in templates.items()]
    for m in machines:
        if not m.opening:
            raise ValueError(f"{m.label}: it opens with no mandatory word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openings = [(len(m.opening), _hash(m.opening), m, sum(x is not None for x in m.step)) for m in machines]
        bases = [(len(words_of(p)), _hash(words_of(p)), label) for p, label in phrases.items()]
        widths = {n for n, *_ in [*openings, *bases]}
        for batch in batches:
            for i, j in chunks(batch.column("text")):
                w = split(batch.column("text").slice(i, j - i), lower=True, separator=NOT_WORD)
                n = j - i
                places: list[list[int]] = [[] for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                found: list[list[dict]] = [[] for _ in range(n)]
                score = [0.0] * n
                if len(w.hash):
                    rest, hashed = w.rest, {k: windows(w.hash, k) for k in widths}
                    at = lambda k, h: np.flatnonzero((hashed[k] == h) & (rest >= k)).tolist()  # noqa: E731, B023
                    row_of = lambda p: int(np.searchsorted(w.first, p, side="right")) - 1  # noqa: E731, B023
                    for width, h, label in bases:
                        for p in at(width, h):
                            row = row_of(p)
                            places[row].append(p - int(w.first[row]))
                            base[row].add(label)
                            score[row] = max(score[row], 0.5)
                    raw = None
                    for width, h, machine, size in openings:
                        for p in at(width, h):
                            row = row_of(p)
                            raw = raw or w.data.tobytes()
                            ended = machine.accept(raw[w.start[x] : w.end[x]] for x in range(p, int(w.first[row + 1])))
                            if ended:
                                found[row].append({"label": machine.label, "first": p - int(w.first[row]), "words": ended[0]})
                                score[row] = max(score[row], ended[1] / size)
                join = lambda x: ",".join(sorted(x))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), pa.array(np.diff(w.first)), pa.array([len(x) for x in places], pa.int64()), pa.array([min(x, default=None) for x in places], pa.int64()),
                     pa.array([max(x, default=None) for x in places], pa.int64()), pa.array([join(x) for x in base], pa.string()),
                     pa.array([join(b | {m["label"] for m in f}) for b, f in zip(base, found, strict=True)], pa.string()), pa.array(score, pa.float64()),
                     pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("words", pa.int32())])))],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")
