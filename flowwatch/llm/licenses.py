"""License scans by template-markup matching (operator 9).

A template is wording with optional and replaceable regions, in the markup of
public license lists: <<beginOptional>> ... <<endOptional>>, and
<<var;name=...;match=...>>, whose match is "a|b" (one of these words) or
".{m,n}" (m to n words of any kind).  It is compiled into an automaton over
words.  A text holds the license if some stretch of its words is accepted, so
all mandatory wording must be there exactly and in order.  Besides, fixed base
phrases are looked up word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowwatch.llm.common import python_tasks

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: texts in ``license_texts``
LONG_TEXTS = 8

# Wording that several short licenses share.
_N = "<<beginOptional>><<var;name=number;match={}>><<endOptional>> "
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so")
_MIT_CONDITION = (
    ", subject to the following conditions: The above copyright notice and this permission notice "
    "<<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. ")
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;match=.{1,15}>> BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE")
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: " + _N.format("1|a|i") + "Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. " + _N.format("2|b|ii") + "Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution. ")
_BSD_ADVERTISING = _N.format("3|c|iii") + (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    "This product includes software developed by <<var;name=holder;match=.{1,20}>> ")
_BSD_NAMES = _N.format("3|4|c|d|iii|iv") + (
    "Neither the <<var;name=names;match=name|names>> of <<var;name=holder;match=.{1,15}>> nor the names of <<beginOptional>>"
    "<<var;name=whose;match=its|their|any>> <<endOptional>>contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. ")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY <<var;name=holder;match=.{1,15}>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "<<var;name=holder;match=.{1,15}>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")
_ISC_GRANT = ("Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or "
              "without fee is hereby granted")
_ISC_CONDITION = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;name=holder;match=.{1,15}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=holder;match=.{1,15}>> BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE "
    "OF THIS SOFTWARE")
_UNDER = "<<var;name=verb;match=released|licensed|distributed|available>> under the <<beginOptional>>terms of the <<endOptional>>"
_FREE = "is free software: you can redistribute it and/or modify it under the terms of the GNU "

# Templates by label.  A -notice is a sentence or file header that grants a license; a
# -text is the whole license, from its first to its last term.  Copyright lines, titles and
# appendices lie outside of the stretch and may be any.
TEMPLATES = {
    "mit-notice": _UNDER + "MIT License",
    "mit-text": _MIT_GRANT + _MIT_CONDITION + _MIT_WARRANTY,
    "mit-0-text": _MIT_GRANT + ". " + _MIT_WARRANTY,
    "json-text": _MIT_GRANT + _MIT_CONDITION + "The Software shall be used for Good, not Evil. " + _MIT_WARRANTY,
    "apache-2.0-notice": _UNDER + "Apache License<<beginOptional>>, Version<<endOptional>> 2.0",
    "gpl-notice": "<<beginOptional>><<var;name=work;match=.{1,3}>> is <<endOptional>>"
                  "<<var;name=verb;match=released|licensed|distributed>> under the <<beginOptional>>terms of the "
                  "<<endOptional>><<beginOptional>>GNU <<endOptional>>General Public License"
                  "<<beginOptional>>, version <<var;name=version;match=1|2|3>><<endOptional>>",
    "gpl-header-notice": _FREE + "General Public License as published by the Free Software Foundation",
    "lgpl-notice": _UNDER + "<<beginOptional>>GNU <<endOptional>><<var;name=kind;match=lesser|library>> General Public License",
    "lgpl-header-notice": _FREE + "<<var;name=kind;match=lesser|library>> General Public License as published by the Free "
                                  "Software Foundation",
    "agpl-notice": _UNDER + "<<beginOptional>>GNU <<endOptional>>Affero General Public License",
    "agpl-header-notice": _FREE + "Affero General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": _UNDER + "Mozilla Public License<<beginOptional>>, <<var;name=word;match=version|v>><<endOptional>> 2.0",
    "mpl-2.0-header-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                             "was not distributed with this file, You can obtain one at <<var;name=scheme;match=http|https>>"
                             "://<<beginOptional>>www.<<endOptional>>mozilla.org/MPL/2.0/",
    "bsd-2-clause-text": _BSD_GRANT + _BSD_WARRANTY,
    "bsd-3-clause-text": _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY,
    "bsd-4-clause-text": _BSD_GRANT + _BSD_ADVERTISING + _BSD_NAMES + _BSD_WARRANTY,
    "isc-notice": _UNDER + "ISC License",
    "isc-text": _ISC_GRANT + _ISC_CONDITION + _ISC_WARRANTY,
    "0bsd-text": _ISC_GRANT + _ISC_WARRANTY,
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE"),
    "cc-notice": "<<var;name=verb;match=released|licensed|distributed|available>> under <<beginOptional>>the terms of "
                 "<<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>a <<endOptional>>CC BY"
                 "<<beginOptional>>-NC<<endOptional>><<beginOptional>>-<<var;name=clause;match=sa|nd>><<endOptional>> "
                 "<<var;name=version;match=1|2|3|4>>.<<var;name=minor;match=0|5>>",
}
# Long licenses, from their files: <label>.txt is the template <label>-text.
_LONG = {p.name.removesuffix(".txt"): p.read_text() for p in (files(__package__) / "license_texts").iterdir() if p.name.endswith(".txt")}
if len(_LONG) != LONG_TEXTS:
    raise ImportError(f"{len(_LONG)} of {LONG_TEXTS} long license texts came with the package")
TEMPLATES |= {f"{name}-text": _LONG[name] for name in sorted(_LONG)}

# What parts words from each other, over the bytes of a text.
_PARTING = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b in _PARTING else b for b in range(256))

_TAG = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


class Template:
    """A template's automaton: ``moves[state]`` are (words or None for any, next state),
    ``free[state]`` the states reached without a word; state 0 starts, the last one accepts."""

    def __init__(self, label: str, markup: str):
        self.label, self.markup = label, markup
        self.moves: list[list[tuple[frozenset | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        opened, mandatory = [], set()
        for n, part in enumerate(_TAG.split(markup)):
            if n % 2 == 0:
                for w in words_of(part.encode()):
                    self._step(frozenset([w]))
                    if not opened:
                        mandatory.add(w)
            elif part == "beginOptional":
                opened.append(len(self.moves) - 1)
            elif part == "endOptional":
                self.free[opened.pop()].append(len(self.moves) - 1)
            else:
                self._replaceable(dict(x.split("=", 1) for x in part.split(";")[1:])["match"])
        if opened or not mandatory:
            raise ValueError(f"template {label}: unclosed optional region or no mandatory wording")
        self.mandatory = frozenset(mandatory)
        self.free = [self._closure(s) for s in range(len(self.free))]

    def _step(self, words: frozenset | None) -> None:
        self.moves[-1].append((words, len(self.moves)))
        self.moves.append([])
        self.free.append([])

    def _replaceable(self, match: str) -> None:
        if some := re.fullmatch(r"\.\{(\d+),(\d+)\}", match):
            least, most = map(int, some.groups())
            skips = []
            for k in range(most):
                if k >= least:
                    skips.append(len(self.moves) - 1)
                self._step(None)
            for s in skips:
                self.free[s].append(len(self.moves) - 1)
        else:
            self._step(frozenset(w.encode() for w in match.split("|")))

    def _closure(self, state: int) -> list[int]:
        seen, todo = {state}, [state]
        while todo:
            new = set(self.free[todo.pop()]) - seen
            seen |= new
            todo += new
        return sorted(seen)

    @cached_property
    def starts(self) -> frozenset | None:
        """Words that an accepted stretch can start with; None: any."""
        found: set = set()
        for s in self.free[0]:
            for words, _ in self.moves[s]:
                if words is None:
                    return None
                found |= words
        return frozenset(found)

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted stretch from ``start``, or -1."""
        states, end, last = set(self.free[0]), -1, len(self.moves) - 1
        for i in range(start, len(words)):
            new: set[int] = set()
            for s in states:
                for accepted, to in self.moves[s]:
                    if accepted is None or words[i] in accepted:
                        new.update(self.free[to])
            if not new:
                break
            states = new
            if last in states:
                end = i + 1
        return end

    def found(self, words: list[bytes], there: set[bytes]) -> tuple[int, int] | None:
        """The first accepted stretch, the longest from its start."""
        if not self.mandatory <= there:
            return None
        for i, w in enumerate(words):
            if (self.starts is None or w in self.starts) and (end := self.longest(words, i)) > 0:
                return i, end
        return None

    def pattern(self) -> str:
        """The same language as a regular expression over words each led by a space."""
        return self._pattern

    @cached_property
    def _pattern(self) -> str:
        out = []
        for n, part in enumerate(_TAG.split(self.markup)):
            if n % 2 == 0:
                out += [f" {w.decode()}" for w in words_of(part.encode())]
            elif part.endswith("Optional"):
                out.append("(?:" if part.startswith("begin") else ")?")
            else:
                match = dict(x.split("=", 1) for x in part.split(";")[1:])["match"]
                some = re.fullmatch(r"\.(\{\d+,\d+\})", match)
                out.append(f"(?: [^ ]+){some[1]}" if some else f" (?:{match})")
        return "".join(out)


def scan(text: bytes | None, templates: list[Template], phrases: dict[str, str]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, all labels, score, stretches of one text."""
    words = words_of(text)
    there = set(words)
    at, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.encode().split()
        if all(w in there for w in p):
            found = [i for i, w in enumerate(words) if w == p[0] and words[i:i + len(p)] == p]
            if found:
                at += found
                labels.add(label)
    base = sorted(labels)
    stretches = []
    for t in templates:
        if stretch := t.found(words, there):
            labels.add(t.label)
            stretches.append((t.label, *stretch))
    score = 1.0 if stretches else 0.5 if at else 0.0
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base),
            ",".join(sorted(labels)), score, stretches)


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None,
                   phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of those, from 0, else null), base_labels, labels
    (base ones and those of accepted templates; both distinct, sorted, comma-joined), score
    (1: a template's mandatory wording, of a notice or a whole license, is there in full; 0.5: only a base phrase; 0: neither)
    and stretches (label, start, end in words) of accepted templates.

    Null and empty texts have no words and no labels (empty strings).  Rows without
    an id, and rows repeating one, are scanned like any other.  Other columns are
    not read.  An empty table gives no rows.
    """
    python_tasks(docs.sparkSession)
    markup, known = templates or TEMPLATES, phrases or PHRASES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [Template(k, v) for k, v in markup.items()]
        for pdf in batches:
            out = pd.DataFrame([scan(t, compiled, known) for t in pdf["text"]], columns=[
                "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "stretches"])
            out["stretches"] = [[{"label": a, "start": b, "end": c} for a, b, c in s] for s in out["stretches"]]
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, stretches array<struct<label string, start long, end long>>")


def license_report(docs: DataFrame) -> DataFrame:
    return scan_documents(docs).drop("stretches")


def oracle_sql() -> str:
    """The report in SQL; templates as regular expressions."""
    label = "\n".join(f"  case when regexp_matches(s, '{Template(k, v).pattern()}(?: |$)') then ['{k}'] else [] end ||"
                      for k, v in TEMPLATES.items())
    places = "\n".join(
        "  list_transform(list_filter(range(len(w)), lambda i: " + " and ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(p.split(), 1))
        + f"), lambda i: {{'at': i, 'label': '{lab}'}}) ||" for p, lab in PHRASES.items())
    return rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
u as (select doc_id, w, ' ' || array_to_string(w, ' ') as s from t),
v as (select doc_id, len(w) as n_words,
{places} [] as p,
{label} [] as l from u),
x as (select *, list_sort(list_distinct(list_transform(p, lambda q: q.label))) as b from v)
select doc_id, n_words::bigint as n_words, len(p)::bigint as n_base,
  list_min(list_transform(p, lambda q: q.at))::bigint as first_word, list_max(list_transform(p, lambda q: q.at))::bigint as last_word,
  array_to_string(b, ',') as base_labels, array_to_string(list_sort(list_distinct(b || l)), ',') as labels,
  case when len(l) > 0 then 1.0::double when len(p) > 0 then 0.5::double else 0.0::double end as score
from x
"""
