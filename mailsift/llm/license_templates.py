"""License scans by template-markup matching.

A template is wording with markup in the style of license lists: text between
``<<beginOptional>>`` and ``<<endOptional>>`` may be missing (regions nest),
``<<var;words=N>>`` stands for up to N words of any kind, and everything else
is mandatory. Templates are compiled into automata over word tokens. A place
of a text is accepted when a run of its consecutive words takes an automaton
from its start to its end, that is, when all mandatory words stand there
exactly, in order, with nothing but optional and replaceable wording between.

Words are the runs of ASCII letters, digits and non-ASCII characters of the
text with A-Z lowered. A scan looks for the words every match must begin with
and runs the automaton from there, so a text costs one pass and matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Phrases and the labels they give.
BASE_TEMPLATES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

#: The shared conditions and disclaimer of the BSD licenses.
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and <<beginOptional>>/or<<endOptional>> other materials provided with the distribution")
_BSD_DISCLAIMER = (
    "this software is provided by <<var;words=10>> as is and any express or implied warranties including but not limited "
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "<<var;words=10>> be liable for any direct indirect incidental special exemplary or consequential damages including "
    "but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")

#: Wording of public licenses, as templates of our own. A license's
#: name is the label of its whole wording; its first words alone are an opening.
LICENSE_TEMPLATES = [
    ("apache-notice", "licensed under the apache license <<beginOptional>>version 2.0<<endOptional>>"),
    ("apache-header", "licensed under the apache license version 2.0 <<beginOptional>>the license<<endOptional>> "
                      "you may not use this file except in compliance with the license"),
    ("mit-notice", "released under the "
                   "<<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and <<beginOptional>>/or<<endOptional>> sell copies "
            "of the software and to permit persons to whom the software is furnished to do so subject to the following "
            "conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph"
            "<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided "
            "as is without warranty of any kind express or implied including but not limited to the warranties of "
            "merchantability fitness for a particular purpose and noninfringement in no event shall <<var;words=10>> be liable "
            "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
            "or in connection with the software or the use or other dealings in the software"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "<<beginOptional>>/or<<endOptional>> associated documentation files <<beginOptional>>the software"
            "<<endOptional>> to deal in the software without restriction"),
    ("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_CONDITIONS} <<beginOptional>>3<<endOptional>> neither the name of <<var;words=12>> nor the names of "
                     "its contributors may be used to endorse or promote products derived from this software without specific "
                     f"prior written permission {_BSD_DISCLAIMER}"),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted "
            "<<beginOptional>>subject to the limitations in the disclaimer below<<endOptional>> provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and <<beginOptional>>/or<<endOptional>> distribute this software for any purpose "
            "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
            "in all copies the software is provided as is and <<var;words=6>> disclaims all warranties with regard to this "
            "software including all implied warranties of merchantability and fitness in no event shall <<var;words=6>> be "
            "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
            "use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
            "connection with the use or performance of this software"),
    ("isc-opening", "permission to use copy modify and <<beginOptional>>/or<<endOptional>> distribute this software for any "
            "purpose with or without fee is hereby granted"),
    ("gpl-notice", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu "
                   "<<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license "
                   "<<beginOptional>>version <<var;words=2>><<endOptional>>"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                   "general public license as published by the free software foundation either version "
                   "<<var;words=2>> of the license or at your option any later version"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license "
            "<<beginOptional>>v <<var;words=2>><<endOptional>>"),
    ("cc-notice", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
                  "<<beginOptional>>creative commons<<endOptional>> cc by <<beginOptional>>nc<<endOptional>> "
                  "<<beginOptional>>sa<<endOptional>> <<beginOptional>>nd<<endOptional>> "
                  "<<beginOptional>><<var;words=2>><<endOptional>>"),
    ("copyright-notice", "copyright <<beginOptional>>c<<endOptional>> <<var;words=8>> all rights reserved"),
]

_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).isalpha() else 0x20 for b in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+))>>")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


@dataclass
class Automaton:
    """States 0..end; ``word[s]`` is the word that leads from s to s+1 (None:
    any word), ``skip[s]`` the states reached from s without a word."""
    label: str
    lead: bytes
    word: list[bytes | None]
    skip: list[set[int]]

    def accept(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run from ``start``, or -1."""
        end, found = len(self.word), -1
        states = self._closed({0})
        at = start
        while states:
            if end in states:
                found = at
            if at >= len(words):
                break
            w = words[at]
            states = self._closed({s + 1 for s in states if s < end and (self.word[s] is None or self.word[s] == w)})
            at += 1
        return found

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template, which must begin with mandatory words: they
    are its ``lead``."""
    word: list[bytes | None] = []
    skip: list[set[int]] = [set()]
    opened: list[int] = []
    lead: list[bytes] = []
    leading = True

    def step(w):
        word.append(w)
        skip.append(set())

    at = 0
    for mark in [*_MARK.finditer(template), None]:
        own = words_of(template[at:mark.start() if mark else len(template)].encode())
        for w in own:
            step(w)
        if not opened and leading and own:
            lead = own
            leading = False
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            opened.append(len(word))
        elif mark[1] == "endOptional":
            skip[opened.pop()].add(len(word))
        else:
            first = len(word)
            for _ in range(int(mark[2])):
                step(None)
            for s in range(first, len(word)):
                skip[s].add(len(word))
    if opened or not lead or template.lstrip().startswith("<<"):
        raise ValueError(f"template {label}: an open region, or no mandatory words at its start")
    return Automaton(label, b" " + b" ".join(lead) + b" ", word, skip)


def scan(words: list[bytes], automata: list[Automaton]) -> list[tuple[str, int, int]]:
    """(label, first word, end) of every accepted place."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for a in automata:
        at, index, counted = joined.find(a.lead), 0, 0
        while at >= 0:
            index += joined.count(b" ", counted, at)
            counted = at
            end = a.accept(words, index)
            if end >= 0:
                out.append((a.label, index, end))
            at = joined.find(a.lead, at + 1)
    return out


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for lo, hi in sorted(spans):
        total += max(0, hi - max(lo, reach))
        reach = max(reach, hi)
    return total


def _scan_batches(base, more):
    names = ["doc_id", "n_words", "base_spans", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [compile_template(*t) for t in base]
        other = [compile_template(*t) for t in more]
        for b in batches:
            counts, base_spans, spans, covered = [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                found, rest = scan(words, own), scan(words, other)
                covered.append(_covered([s[1:] for s in found + rest]))
                for to, part in ((base_spans, found), (spans, rest)):
                    to.append([{"label": x, "first_word": lo, "end_word": hi} for x, lo, hi in part])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(base_spans, span), pa.array(spans, span),
                 pa.array(covered, pa.int64())], [*names, "n_covered"])
    return run


def scan_licenses(docs: DataFrame, base=tuple(BASE_TEMPLATES), more=tuple(LICENSE_TEMPLATES),
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base_spans, spans, n_covered) of every whole text: all
    accepted places of the templates, and how many words they cover.

    Defined cases: null, empty and wordless texts have no words and no places;
    repeated rows, equal and null ids are scanned row by row; overlapping places
    are all reported, covered words counted once; an empty table gives no rows;
    other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    span = "array<struct<label: string, first_word: bigint, end_word: bigint>>"
    return rows.mapInArrow(_scan_batches(list(base), list(more)),
                           f"doc_id long, n_words long, base_spans {span}, spans {span}, n_covered long")
