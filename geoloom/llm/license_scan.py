"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is text with SPDX-like markup: <<opt>> ... <<end>> may be left out; <<var words=1-4 match=REGEX>>
stands for that many words, each matching REGEX wholly.  All other words are mandatory and must stand
exactly, in order.  Words are runs of digits, letters and non-ASCII characters of the lower-cased text, so that
case, punctuation and line breaks don't matter.  An automaton is only run near its key, the longest run of mandatory words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import texts_of

# The base phrases and their labels, from the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_VERB = "<<opt>><<var words=1-1 match=licensed|released|distributed|available|provided|published|redistributed>><<end>> under"
_TERMS = "<<opt>>the terms <<opt>>and conditions<<end>> of<<end>>"
# Passages that several licences have.
_NO_CLAIM = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var words=1-8 match=.*>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_FORMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "<<opt>>3<<end>> neither the name of <<var words=1-12 match=.*>> nor the names of <<var words=1-4 match=.*>> may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_CLAIM = "this software is provided by the <<var words=1-10 match=.*>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the <<var words=1-10 match=.*>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
# Wordings of well-known licence notices, and whole texts of short licences, with what may vary in them marked.
TEMPLATES = {
    "apache-2.0": f"{_VERB} {_TERMS} the apache license <<opt>>version<<end>> 2.0",
    "mit": f"{_VERB} {_TERMS} the mit <<opt>>x11<<end>> license",
    "bsd": f"{_VERB} {_TERMS} <<var words=1-1 match=the|a>> <<opt>><<var words=1-2 match=[234]|clause|new|modified|simplified>><<end>> bsd <<opt>><<var words=1-2 match=[234]|clause>><<end>> license",
    "mpl-2.0": f"{_VERB} {_TERMS} the mozilla public license <<opt>>v<<end>> <<opt>>version<<end>> 2.0",
    "gpl-2.0": f"{_VERB} {_TERMS} the gnu general public license <<opt>>as published by the free software foundation either<<end>> <<opt>>version<<end>> <<var words=1-1 match=2|v2>>",
    "gpl-3.0": f"{_VERB} {_TERMS} the gnu general public license <<opt>>as published by the free software foundation either<<end>> <<opt>>version<<end>> <<var words=1-1 match=3|v3>>",
    "lgpl": f"{_VERB} {_TERMS} the gnu <<var words=1-1 match=lesser|library>> general public license",
    "agpl": f"{_VERB} {_TERMS} the gnu affero general public license",
    "cc-by-4.0": f"{_VERB} {_TERMS} <<opt>>a<<end>> <<opt>>the<<end>> cc by <<var words=1-1 match=[1-4]>> 0",
    "cc-by-sa": f"{_VERB} {_TERMS} <<opt>>a<<end>> <<opt>>the<<end>> cc by sa",
    "cc-by-nc": f"{_VERB} {_TERMS} <<opt>>a<<end>> <<opt>>the<<end>> cc by nc <<opt>><<var words=1-1 match=sa|nd>><<end>> <<opt>><<var words=1-1 match=[1-4]>> 0<<end>>",
    "cc0": f"{_VERB} {_TERMS} <<opt>>the<<end>> cc0",
    "copyright-reserved": "<<opt>>copyright <<opt>>c<<end>> <<var words=1-8 match=.*>><<end>> all rights reserved",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this <<var words=1-6 match=.*>> and associated documentation <<opt>>files<<end>> <<opt>>the software<<end>> to deal in the <<var words=1-2 match=.*>> without restriction",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mit-whole": f"permission is hereby granted free of charge to any person obtaining a copy of this <<var words=1-6 match=.*>> and associated documentation <<opt>>files<<end>> <<opt>>the <<var words=1-1 match=software|materials>><<end>> to deal in the <<var words=1-2 match=.*>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software {_NO_CLAIM}",
    "isc-whole": "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var words=1-8 match=.*>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var words=1-8 match=.*>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-whole": f"{_BSD_FORMS} {_BSD_CLAIM}",
    "bsd-3-whole": f"{_BSD_FORMS} {_BSD_NAMES} {_BSD_CLAIM}",
    "zlib-whole": "this software is provided as is without any express or implied warranty in no event will the <<var words=1-4 match=.*>> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<opt>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an <<var words=1-1 match=acknowledge?ment>> in the product documentation would be appreciated but is not required <<opt>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<opt>>3<<end>> this notice may not be removed or altered from any source distribution",
    "unlicense-whole": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_NO_CLAIM}",
}

_MARK = re.compile(r"<<(opt|end|var)([^>]*)>>")
#: Bytes of a lower-cased text that stand between words become spaces.
_TABLE = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbered; steps[s] lists (word or None, pattern or None, next state), jumps[s] needs no word."""

    label: str
    steps: list[list[tuple]] = field(default_factory=list)
    jumps: list[list[int]] = field(default_factory=list)
    accept: int = -1
    key: bytes = b""
    before: int = 0  # words that can stand before the key
    mandatory: int = 0

    def _state(self) -> int:
        self.steps.append([])
        self.jumps.append([])
        return len(self.steps) - 1

    def closed(self, states) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.jumps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from start; -1 if there is none."""
        states, end, at = self.closed({0}), -1, start
        while states:
            if self.accept in states:
                end = at
            if at == len(words):
                break
            w = words[at]
            states = self.closed({t for s in states for literal, pattern, t in self.steps[s] if (w == literal if pattern is None else pattern.fullmatch(w))})
            at += 1
        return end


def compile_template(label: str, text: str) -> Automaton:
    a = Automaton(label)
    here, opened, run, runs, before = a._state(), [], [], [], 0
    at = 0

    def literal(part: str) -> None:
        nonlocal here, before
        for w in words_of(part.encode()):
            then = a._state()
            a.steps[here].append((w, None, then))
            here = then
            if not opened:
                if not run:
                    runs.append((before, run))
                run.append(w)
                a.mandatory += 1
            before += 1

    for mark in _MARK.finditer(text):
        literal(text[at : mark.start()])
        at = mark.end()
        run = []
        if mark[1] == "opt":
            opened.append(here)
        elif mark[1] == "end":
            a.jumps[opened.pop()].append(here)
        else:
            low, high = map(int, re.search(r"words=(\d+)-(\d+)", mark[2]).groups())
            pattern = re.compile(re.search(r"match=(.*)", mark[2])[1].encode())
            for i in range(high):
                then = a._state()
                a.steps[here].append((None, pattern, then))
                if i >= low:
                    a.jumps[here].append(-1)
                here = then
            for s in range(len(a.jumps)):
                a.jumps[s] = [here if t == -1 else t for t in a.jumps[s]]
            before += high
    literal(text[at:])
    a.accept = here
    start, best = max(runs, key=lambda r: len(b" ".join(r[1])))
    a.key, a.before = b" " + b" ".join(best) + b" ", start
    return a


def places(flat: bytes, phrase: bytes) -> list[int]:
    """Words (from 0) at which a phrase (a space at both ends) stands in words joined by spaces, in one pass."""
    out, word, seen, at = [], 0, 0, flat.find(phrase)
    while at >= 0:
        word += flat.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = flat.find(phrase, at + 1)
    return out


class Scanner:
    """Base phrases and compiled templates, applied to one text at a time."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]
        self.automata = [compile_template(label, text) for label, text in templates.items()]

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
        """How many words; base hits (start word, label); template hits (label, start word, end word)."""
        words = words_of(data)
        flat = b" " + b" ".join(words) + b" "
        base, hits = [], []
        for phrase, label in self.phrases:
            base += [(start, label) for start in places(flat, phrase)]
        for a in self.automata:
            last = -1
            for key in places(flat, a.key):
                for start in range(max(last, key - a.before, 0), key + 1):
                    if (end := a.longest(words, start)) > key:
                        hits.append((a.label, start, end))
                        last = end
                        break
        return len(words), sorted(base), sorted(hits, key=lambda h: h[1:])


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base (start, label), matches (label, start, end), score of every row of docs (doc_id, text).

    Positions are words from 0, ends exclusive; a null text is empty.  Of a template's accepted runs around one
    key place the earliest start and its longest end count; runs of one template don't overlap.  score: 1 if a template was
    accepted, else 0.5 if a base phrase was found, else 0.  Rows are judged alone, repeated ones too.
    """

    def make(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            n, base, matches, score = [], [], [], []
            for data in texts_of(batch.column(1)):
                count, b, m = scanner.scan(data)
                n.append(count)
                base.append([{"start": s, "label": x} for s, x in b])
                matches.append([{"label": x, "start": s, "end": e} for x, s, e in m])
                score.append(1.0 if m else 0.5 if b else 0.0)
            spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            starts = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, starts), pa.array(matches, spans), pa.array(score, pa.float64())], ["doc_id", "n_words", "base", "matches", "score"])

    schema = "doc_id long, n_words long, base array<struct<start:long,label:string>>, matches array<struct<label:string,start:long,end:long>>, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, schema)
