"""License scans by template-markup matching.

A template is license wording with markup:

* plain words are mandatory and must stand exactly like that,
* ``[ … ]`` is an optional region, present as a whole or absent; regions nest,
* ``{a|b c}`` is a replaceable region with its allowed wordings,
* ``<n-m>`` is a replaceable region of n to m words of any kind.

All templates are compiled into one automaton over words.  A state is a set of
places in templates (a bit mask); the steps between states are worked out when
they are first met and remembered, so a text is walked word by word with one
look-up each.  Words outside the templates are one class.  A walk starts
wherever a template can start and ends when no place is left, at the latest
after the longest wording.  A template is accepted when its end is reached,
which is the case only if every mandatory word stood where it should.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalforms.llm.common import in_blocks

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 20  # bytes of a text read at once; pieces end between words
OTHER = 0  # class of the words that no template names

PHRASES = {  # fixed values: words of the base rule and their labels
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-notice", "{released|licensed|distributed|available} under the [terms of the] mit license"),
    ("apache-2.0", "licensed under the [terms of the] apache license [version] 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at"),
    ("gpl-2.0", "[under the terms of] [the] gnu general public license [as published by the free software foundation] "
                "[either] {version 2|v2} [only]"),
    ("gpl-2.0-or-later", "[the] gnu general public license [as published by the free software foundation] [either] "
                         "{version 2|v2} [of the license] or [at your option] any later version"),
    ("gpl-3.0", "[under the terms of] [the] gnu general public license [as published by the free software foundation] "
                "[either] {version 3|v3} [only]"),
    ("gpl-3.0-or-later", "[the] gnu general public license [as published by the free software foundation] [either] "
                         "{version 3|v3} [of the license] or [at your option] any later version"),
    ("cc-by-4.0", "{licensed|available|released} under [a|the] {cc by|creative commons attribution} "
                  "[international] [license] 4 0"),
    ("cc-by-nc-4.0", "{licensed|available|released} under [a|the] {cc by nc|creative commons attribution noncommercial} "
                     "[international] [license] 4 0"),
    ("cc-by-sa-4.0", "{licensed|available|released} under [a|the] {cc by sa|creative commons attribution sharealike} "
                     "[international] [license] 4 0"),
    ("cc0-1.0", "[{licensed|released|available} under] {cc0|cc zero} [1 0] [universal] [public domain dedication]"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions the above copyright notice and this permission notice [including the next "
                 "paragraph] shall be included in all copies or substantial portions of the software"),
    ("isc-text", "permission to use copy modify and {or|} distribute this software for any purpose with or without fee "
                 "is hereby granted provided that the above copyright notice and this permission notice appear in all "
                 "copies"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted "
                     "provided that the following conditions are met [1] redistributions of source code must retain "
                     "the above copyright notice this list of conditions and the following disclaimer [2] "
                     "redistributions in binary form must reproduce the above copyright notice this list of "
                     "conditions and the following disclaimer in the documentation and or other materials provided "
                     "with the distribution"),
    ("bsd-3-clause", "redistributions in binary form must reproduce the above copyright notice this list of "
                     "conditions and the following disclaimer in the documentation and or other materials provided "
                     "with the distribution [3] neither the name of <1-12> nor the names of its contributors may be "
                     "used to endorse or promote products derived from this software without specific prior written "
                     "permission"),
    ("all-rights-reserved", "copyright [c] <1-8> all rights reserved"),
    ("public-domain", "[this work is] {released|dedicated|placed} {into|to|in} the public domain"),
)

OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
       "score double")

_MARKUP = re.compile(r"[\[\]{}|]|<\d+-\d+>|[^\s\[\]{}|<>]+")


def parse(template: str) -> list:
    """Sequence of words, ("any of", [sequences]) and ("gap", n, m); an optional region has the empty sequence too."""
    tokens = _MARKUP.findall(template) + ["end"]
    at = 0

    def sequence(closing: str | None) -> list[list]:
        nonlocal at
        options: list[list] = [[]]
        while at < len(tokens) - 1:
            token = tokens[at]
            at += 1
            if token == closing:
                return options
            if token == "|" and closing:
                options.append([])
            elif token == "[":
                options[-1].append(("any of", [*sequence("]"), []]))
            elif token == "{":
                options[-1].append(("any of", sequence("}")))
            elif token in "]}|":
                raise ValueError(f"unexpected {token} in template: {template}")
            elif token[0] == "<":
                low, high = map(int, token[1:-1].split("-"))
                if low > high:
                    raise ValueError(f"empty gap {token} in template: {template}")
                options[-1].append(("gap", low, high))
            else:
                options[-1].append(token.lower().encode())
        if closing:
            raise ValueError(f"region without {closing} in template: {template}")
        return options

    return sequence(None)[0]


class Automaton:
    """Templates compiled over words: places with a step by a word (or by any word) and free steps between places."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        self.classes: dict[bytes, int] = {}
        self._by_word: list[tuple[int | None, int]] = []  # (class or None for any word, next place), one a place
        self._free: list[list[int]] = []
        starts, self._ends = [], {}
        for number, (_, template) in enumerate(templates):
            start = self._place()
            starts.append(start)
            self._ends[self._sequence(parse(template), start)] = number
        self._closed = [self._closure(p) for p in range(len(self._free))]
        self._end_mask = sum(1 << p for p in self._ends)
        self.start = 0
        for p in starts:
            self.start |= self._closed[p]
        if self.start & self._end_mask:
            raise ValueError("a template must have a mandatory word")
        self._steps: dict[tuple[int, int], int] = {}
        self._accepted: dict[int, tuple[int, ...]] = {}
        self.first = frozenset(k for k in (*self.classes.values(), OTHER) if self.step(self.start, k))

    def _place(self) -> int:
        self._by_word.append((-1, 0))
        self._free.append([])
        return len(self._free) - 1

    def _word(self, at: int, label: int | None) -> int:
        after = self._place()
        self._by_word[at] = (label, after)
        return after

    def _sequence(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                at = self._word(at, self.classes.setdefault(part, len(self.classes) + 1))
            elif part[0] == "gap":
                low, high = part[1:]
                skipped = []
                for i in range(high):
                    if i >= low:
                        skipped.append(at)
                    at = self._word(at, None)
                for p in skipped:
                    self._free[p].append(at)
            else:
                after = self._place()
                for option in part[1]:
                    begin = self._place()
                    self._free[at].append(begin)
                    self._free[self._sequence(option, begin)].append(after)
                at = after
        return at

    def _closure(self, place: int) -> int:
        """The place and those reached from it by free steps, as a mask."""
        mask, todo = 0, [place]
        while todo:
            p = todo.pop()
            if not mask >> p & 1:
                mask |= 1 << p
                todo += self._free[p]
        return mask

    def step(self, state: int, label: int) -> int:
        """The state after one more word of this class; 0 if no place is left."""
        key = (state, label)
        found = self._steps.get(key)
        if found is None:
            found, rest = 0, state
            while rest:
                low = rest & -rest
                wanted, after = self._by_word[low.bit_length() - 1]
                if wanted is None or wanted == label:
                    found |= self._closed[after]
                rest ^= low
            self._steps[key] = found
        return found

    def accepted(self, state: int) -> tuple[int, ...]:
        """Numbers of the templates that end in this state."""
        if not state & self._end_mask:
            return ()
        found = self._accepted.get(state)
        if found is None:
            found = self._accepted[state] = tuple(n for p, n in self._ends.items() if state >> p & 1)
        return found

    def classes_of(self, text: bytes) -> array:
        """The word classes of a text, read in pieces so that only two bytes a word stay."""
        out, start, known = array("H"), 0, self.classes
        while start < len(text):
            cut = _BREAK.search(text, start + PIECE)
            end = cut.start() if cut else len(text)
            out.extend([known.get(w, OTHER) for w in WORD.findall(text, start, end)])
            start = end
        return out

    def matches(self, labels: array) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of every accepted stretch of words."""
        step, size = self.step, len(labels)
        can_start = np.zeros(len(self.classes) + 1, bool)
        can_start[list(self.first)] = True
        for begin in np.flatnonzero(can_start[np.frombuffer(labels, np.uint16)]).tolist() if size else ():
            state, i = self.start, begin
            while i < size:
                state = step(state, labels[i])
                i += 1
                if not state:
                    break
                for number in self.accepted(state):
                    yield number, begin, i


@lru_cache(maxsize=4)
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    """One automaton of the base phrases, which come first, and the templates."""
    return Automaton((*[(label, phrase) for phrase, label in PHRASES.items()], *templates))


def scan_text(text: bytes, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    walk = automaton(templates)
    words = walk.classes_of(text.lower())
    n_base, first, last, base, labels = 0, None, None, set(), set()
    inside = reached = 0  # starts ascend, so covered words are counted on the way
    for number, begin, end in walk.matches(words):
        if number < len(PHRASES):
            n_base += 1
            first = begin if first is None else first
            last = begin
            base.add(walk.names[number])
        labels.add(walk.names[number])
        inside += max(0, end - max(begin, reached))
        reached = max(reached, end)
    return (len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
            inside / len(words) if words else 0.0)


def license_labels(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    Words are stretches of ASCII letters and digits and of non-ASCII
    characters, A-Z lower-cased.  Base: the places where the words of
    ``PHRASES`` stand one after the other.  ``labels`` has the labels of the
    base and of every template accepted anywhere in the text; ``score`` is the
    share of the words that lie in an accepted wording.  A null or empty text
    has no words, no labels (empty strings) and score 0.  Texts are read whole
    and walked in place; rows are judged each by itself, so repeated rows have
    equal results; other columns are ignored and an empty table gives no rows.
    """
    def block(rows: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        found = list(zip(*[scan_text(t, templates) for t in texts]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return pa.RecordBatch.from_arrays(
            [rows.column(0).cast(pa.int64()), *[pa.array(v, t) for v, t in zip(found, types)]], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_blocks(batches, block)

    return docs.select("doc_id", "text").mapInArrow(work, OUT)
