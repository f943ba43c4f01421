"""Licence templates: markup with optional and replaceable regions, compiled to automata over words.

Markup: ``<<beginOptional>> ... <<endOptional>>`` (nests), ``<<var;name=...;words=LOW-HIGH>>`` for LOW to HIGH words of
any kind; everything else is mandatory wording. A template accepts a stretch of a text if its words, lower-cased, are the
mandatory wording exactly. Automata are made deterministic word by word as texts need it.

Defined cases: a null text is empty; a text without words has counts 0, empty labels, score 0 and null word numbers; repeated
rows are scanned each; an empty table gives an empty result; other columns are ignored. Rows are independent: no shuffle.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatlens.llm.blocks import LOWER, WORDLIKE, Block, Words, blocks
from chatlens.llm.shared import texts_of

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_O, _E = "<<beginOptional>>", "<<endOptional>>"
#: Label and template of the registered query.
TEMPLATES = (
    (
        "notice:apache-2.0",
        f'Licensed under the Apache License{_O}, Version 2.0{_E}{_O} (the "License"); you may not use this file except in '
        f"compliance with the License.{_O} You may obtain a copy of the License at "
        f"<<var;name=address;words=3-9>>{_E}{_E}",
    ),
    (
        "notice:gpl",
        f"{_O}This <<var;name=thing;words=1-3>> is {_E}licensed under the {_O}terms of the {_E}GNU General Public License"
        f"{_O}, version <<var;name=version;words=1-2>>{_E}",
    ),
    (
        "notice:cc-by",
        f"{_O}This work is {_E}licensed under {_O}a Creative Commons Attribution {_E}CC BY{_O}-NC{_E}{_O}-SA{_E}{_O}-ND{_E} "
        f"{_O}<<var;name=version;words=2-2>>{_E}",
    ),
    ("notice:mit", f"{_O}Released{_E}{_O}licensed{_E} under the MIT License"),
    (
        "text:mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        f"copyright notice and this permission notice {_O}(including the next paragraph) {_E}shall be included in all "
        "copies or substantial portions of the Software."
        f'{_O} THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND<<var;name=disclaimer;words=0-80>>{_E}',
    ),
    (
        "text:isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "text:bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        f"following conditions are met: {_O}1. {_E}Redistributions of source code must retain the above copyright notice, "
        f"this list of conditions and the following disclaimer. {_O}2. {_E}Redistributions in binary form must reproduce "
        "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        f"other materials provided with the distribution.{_O} 3. Neither the name of <<var;name=holder;words=1-12>> nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without "
        f"specific prior written permission.{_E}",
    ),
)

_MARK = re.compile(r"<<(.*?)>>", re.S)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes())


class Automaton:
    """Word automaton of one template. States of the deterministic form are sets of template positions."""

    def __init__(self, template: str):
        self.edges: list[dict[bytes, int]] = []  # by position: a mandatory word
        self.any: list[int | None] = []  # by position: any word
        self.skip: list[list[int]] = []  # by position: no word
        end, at, opened = self._new(), 0, []
        for mark in _MARK.finditer(template):
            end, at = self._wording(end, template[at : mark.start()]), mark.end()
            kind, *fields = [f.strip() for f in mark[1].split(";")]
            if kind == "beginOptional":
                opened.append(end)
            elif kind == "endOptional" and opened:
                begin, last, end = opened.pop(), end, self._new()
                self.skip[last].append(end)
                self.skip[begin].append(end)
            elif kind == "var":
                low, high = map(int, dict(f.split("=") for f in fields)["words"].split("-"))
                final = self._new()
                for k in range(high):
                    if k >= low:
                        self.skip[end].append(final)
                    self.any[end] = end = self._new()
                self.skip[end].append(final)
                end = final
            else:
                raise ValueError(f"unknown or unmatched markup: {mark[0]}")
        if opened:
            raise ValueError("an optional region is not closed")
        self.final = self._wording(end, template[at:])
        self.moves: dict[frozenset[int], dict[bytes, frozenset[int]]] = {}
        self.start = self._closed({0})
        if self.final in self.start:
            raise ValueError("the template has no mandatory wording")
        self.first_words = {w for p in self.start for w in self.edges[p]}
        if any(self.any[p] is not None for p in self.start):
            raise ValueError("a template begins with wording, not with a replaceable region")

    def _new(self) -> int:
        self.edges.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.edges) - 1

    def _wording(self, end: int, text: str) -> int:
        for word in words_of(text):
            self.edges[end][word] = end = self._new()
        return end

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for p in self.skip[todo.pop()]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return frozenset(seen)

    def step(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        known = self.moves.setdefault(state, {})
        if word not in known:
            # Words that no position of the state names all behave alike and share one entry.
            named = {p for q in state for w, p in self.edges[q].items() if w == word}
            if not named:
                word = b""
            if word not in known:
                known[word] = self._closed(
                    named | {p for q in state if (p := self.any[q]) is not None}
                )
        return known[word]

    def longest(self, words: list[bytes], start: int) -> int:
        """Where the longest accepted run of words from ``start`` ends; ``start`` if there is none."""
        state, best = self.start, start
        for at in range(start, len(words)):
            state = self.step(state, words[at])
            if not state:
                break
            if self.final in state:
                best = at + 1
        return best


class Scanner:
    """Finds phrases and templates in a block of texts."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.automata = [(label, Automaton(t)) for label, t in templates]
        first = {p[0] for p, _ in self.phrases}.union(*(a.first_words for _, a in self.automata))
        joined = b" ".join(sorted(first))
        one = Block(0, np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
        self.first = np.unique(Words(one, WORDLIKE).hash)

    def scan(self, block: Block) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each text."""
        found = Words(block, WORDLIKE, lower=True)
        hits = np.flatnonzero(np.isin(found.hash, self.first))
        of_text = found.text[hits]
        rows: list[tuple] = [(int(n), 0, None, None, "", "", 0.0, []) for n in found.per_text]
        data = LOWER[block.data]
        for i in np.unique(of_text):
            a, b = found.first[i], found.first[i + 1]
            words = [
                data[s:e].tobytes() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)
            ]
            rows[i] = self._row(words, (hits[of_text == i] - a).tolist())
        return rows

    def _row(self, words: list[bytes], starts: list[int]) -> tuple:
        base, spans = [], []
        for phrase, label in self.phrases:
            n = len(phrase)
            base += [(s, s + n, label) for s in starts if words[s : s + n] == phrase]
        for label, automaton in self.automata:
            free = 0
            for s in starts:
                if s >= free and words[s] in automaton.first_words:
                    end = automaton.longest(words, s)
                    if end > s:
                        spans.append((s, end, label))
                        free = end
        covered, upto = 0, 0
        for s, e, _ in sorted(base + spans):
            covered += max(0, e - max(s, upto))
            upto = max(upto, e)
        at = [s for s, _, _ in base]
        return (
            len(words),
            len(base),
            min(at) if at else None,
            max(at) if at else None,
            ",".join(sorted({x for _, _, x in base})),
            ",".join(sorted({x for _, _, x in base + spans})),
            covered / len(words),
            [{"label": x, "start": s, "end": e} for s, e, x in sorted(spans)],
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long>>"
)


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=PHRASES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row per row of ``docs``: phrase counts, labels, accepted template ``spans`` (word numbers, end exclusive).

    ``score`` is the share of words that stand in a phrase or an accepted stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        names = [f.split()[0] for f in SCHEMA.split(", ")[:8]] + ["spans"]
        for batch in batches:
            for block in blocks(batch.column("text")):
                columns = list(zip(*scanner.scan(block), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        *[pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ],
                    names=names,
                )

    return texts_of(docs, id_column, text_column).mapInArrow(run, SCHEMA)
