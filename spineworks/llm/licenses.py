"""License scans by template-markup matching.

A template is mandatory wording with ``<<opt>>...<</opt>>`` regions that may
be missing and ``<<var:n>>`` regions that stand for 0 to n words. All
templates compile into one token automaton. It starts wherever a text has a
template's first word and accepts where the mandatory wording matches
exactly. Plain phrases are templates without markup.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, text_slices

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var:(\d+)>>")

#: (label, template) of plain phrases whose places are counted.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# The wording of public license notices, and of short references to licenses.
#: (label, template) of whole notices: all of the mandatory wording has to stand there.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files <<opt>>the software<</opt>> to deal in the software without restriction including without "
            "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
            "and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
            "copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all "
            "copies or substantial portions of the software the software is provided as is without warranty of any kind "
            "express or implied including but not limited to the warranties of merchantability fitness for a particular "
            "purpose and noninfringement in no event shall <<var:8>> be liable for any claim damages or other liability "
            "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the "
            "use or other dealings in the software"),
    ("isc", "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee "
            "is hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
            "software is provided as is and <<var:8>> disclaims all warranties with regard to this software including all "
            "implied warranties of merchantability and fitness in no event shall <<var:8>> be liable for any special direct "
            "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in "
            "an action of contract negligence or other tortious action arising out of or in connection with the use or "
            "performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright "
            "notice this list of conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must "
            "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
            "and or other materials provided with the distribution <<opt>><<opt>>3<</opt>> neither the name of <<var:12>> nor "
            "the names of its contributors may be used to endorse or promote products derived from this software without "
            "specific prior written permission<</opt>> this software is provided by <<var:8>> as is and any express or implied "
            "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
            "purpose are disclaimed in no event shall <<var:8>> be liable for any direct indirect incidental special exemplary "
            "or consequential damages including but not limited to procurement of substitute goods or services loss of use "
            "data or profits or business interruption however caused and on any theory of liability whether in contract strict "
            "liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
            "advised of the possibility of such damage"),
    ("apache-2", "licensed under the apache license version 2 0 <<opt>>the license<</opt>> you may not use this file except in "
                 "compliance with the license you may obtain a copy of the license at <<var:8>> unless required by applicable "
                 "law or agreed to in writing software distributed under the license is distributed on an as is basis without "
                 "warranties or conditions of any kind either express or implied see the license for the specific language "
                 "governing permissions and limitations under the license"),
    ("gpl", "this <<var:4>> is free software you can redistribute it and or modify it under the terms of the gnu "
            "<<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by the free software foundation "
            "either version <<var:2>> of the license or at your option any later version this <<var:4>> is distributed in the "
            "hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
            "fitness for a particular purpose see the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license "
            "for more details"),
    ("cc-by-nc", "this work is licensed under <<opt>>a<</opt>> creative commons attribution noncommercial <<var:4>> license"),
    ("cc-by", "this work is licensed under <<opt>>a<</opt>> creative commons attribution <<opt>>4 0<</opt>> "
              "<<opt>>3 0<</opt>> <<opt>>international<</opt>> <<opt>>unported<</opt>> license"),
)
#: (label, template) of short references: they name a license and are not its notice.
REFERENCES = (
    ("apache-2-reference", "licensed under the apache license <<opt>>version<</opt>> 2 <<opt>>0<</opt>>"),
    ("apache-2-reference", "spdx license identifier apache 2 0"),
    ("mit-reference", "<<opt>>released<</opt>> under the <<opt>>terms of the<</opt>> mit license"),
    ("mit-reference", "spdx license identifier mit"),
    ("bsd-reference", "spdx license identifier bsd <<var:1>> clause"),
    ("gpl-reference", "gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license <<opt>>as published by the free "
                      "software foundation<</opt>> <<opt>>either<</opt>> version <<var:1>>"),
    ("gpl-reference", "spdx license identifier <<var:1>> gpl"),
)
TEMPLATES = NOTICES + REFERENCES


def compile_templates(templates) -> tuple[dict, list, dict]:
    """(first word -> states after it, moves of each state, accepted templates of a state).

    A state's moves are (word or None, next state); None takes any word.
    """
    moves: list[list] = []
    accept: dict[int, list[int]] = {}
    skips: list[list[int]] = []

    def state() -> int:
        moves.append([])
        skips.append([])
        return len(moves) - 1

    starts = []
    for t, (_, text) in enumerate(templates):
        at, opened = state(), []
        starts.append(at)
        position = 0
        for mark in [*_MARK.finditer(text), None]:
            for word in _WORD.findall(text[position:mark.start() if mark else len(text)].lower().encode()):
                nxt = state()
                moves[at].append((word, nxt))
                at = nxt
            if mark is None:
                break
            position = mark.end()
            if mark.group() == "<<opt>>":
                opened.append(at)
            elif mark.group() == "<</opt>>":
                nxt = state()
                skips[at].append(nxt)
                skips[opened.pop()].append(nxt)
                at = nxt
            else:
                end = state()
                skips[at].append(end)
                for _ in range(int(mark.group(1))):
                    nxt = state()
                    moves[at].append((None, nxt))
                    skips[nxt].append(end)
                    at = nxt
                at = end
        if opened:
            raise ValueError("an optional region is not closed")
        accept.setdefault(at, []).append(t)

    def reach(s: int) -> set[int]:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(skips[x])
        return seen

    closed = [reach(s) for s in range(len(moves))]
    flat = [[m for x in sorted(c) for m in moves[x]] for c in closed]
    accepted = {s: [t for x in sorted(c) for t in accept.get(x, [])] for s, c in enumerate(closed)}
    first: dict[bytes, list[int]] = {}
    for s in starts:
        if accepted[s]:
            raise ValueError("a template needs mandatory words")
        for word, nxt in flat[s]:
            if word is None:
                raise ValueError("a template must begin with a word")
            first.setdefault(word, []).append(nxt)
    return first, flat, {s: a for s, a in accepted.items() if a}


def matches(words: list[bytes], automaton) -> list[tuple[int, int, int]]:
    """(template, first word, word after the last) of every place; the longest match of each start."""
    first, moves, accepted = automaton
    found = []
    for start in [i for i, w in enumerate(words) if w in first]:
        states, at, best = set(first[words[start]]), start + 1, {}
        while states:
            for s in states:
                for t in accepted.get(s, ()):
                    best[t] = at
            if at == len(words):
                break
            word = words[at]
            states = {nxt for s in states for w, nxt in moves[s] if w is None or w == word}
            at += 1
        found.extend((t, start, end) for t, end in best.items())
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one for each row.

    base: plain phrases; n_base counts their places, first_word and last_word
    are the smallest and largest start (null without any). labels adds the
    templates'. score: share of the words that lie in a match. spans: (label,
    start, end) of all matches, base phrases included. Null and empty texts
    have no words and score 0. Repeated rows give repeated output rows.
    """
    every, n_base = (*base, *templates), len(base)

    def run(batches):
        automaton = compile_templates(every)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, "text"):
                raw, o, out = LOWER[data].tobytes(), offsets.tolist(), []
                for i, j in zip(o, o[1:]):
                    words = _WORD.findall(raw[i:j])
                    found = matches(words, automaton)
                    own = [f for f in found if f[0] < n_base]
                    covered = np.zeros(len(words) + 1, np.int64)
                    for _, a, b in found:
                        covered[a] += 1
                        covered[b] -= 1
                    score = float((np.cumsum(covered) > 0).sum() / len(words)) if words else 0.0
                    out.append((len(words), len(own), min((f[1] for f in own), default=None),
                                max((f[1] for f in own), default=None), ",".join(sorted({every[f[0]][0] for f in own})),
                                ",".join(sorted({every[f[0]][0] for f in found})), score,
                                [{"label": every[t][0], "start": a, "end": b} for t, a, b in sorted(found, key=lambda f: f[1])]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                         pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double, "
                     "spans array<struct<label: string, start: long, end: long>>")
