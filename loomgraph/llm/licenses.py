"""License scan by template markup: templates with optional and replaceable regions become automata over words.

A template is wording with two kinds of markup: `[[...]]` may be left out (and may nest), and `{{m..n}}` stands for any m to n
words, such as a name or a year. All other words are mandatory and must stand exactly so. `compile_template` makes a
nondeterministic automaton of it, and `Automaton` turns that into a deterministic one while it reads, one set of states at a time, so the
sets that the corpus never meets are never built. A text is accepted wherever an automaton reaches its end from some start.

Each document is read once, whole, in its task: nothing is shuffled. Long texts go in pieces that overlap by the longest
wording that any template accepts, so memory does not grow with the text. Starts are the words that some template or phrase
can begin with, so automata run over few words.

Labels: `mit`, `apache` and `gpl` for the phrases of PHRASES, and beside them the labels of accepted templates. The score is
the strength of the evidence, 1 - 0.5^phrases * 0.1^templates over distinct labels: 0 without any.

Defined cases: null and empty texts are one and the same, without words, labels or places, of score 0; places may overlap and all of them count;
rows that repeat an id are scanned one by one; null ids stay; an empty table gives no rows; other columns are not read; words of
any length are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, UPPER, python_workers

#: Digits, letters (A-Z in lower case) and all bytes of characters beyond ASCII; everything else parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed by the contract: label and the words that stand for it wherever they are consecutive.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Label and templates. Notices are short; the others are the openings and conditions of public license texts.
TEMPLATES = {
    "notice:mit": ["under the [[terms of the]] [[expat]] mit license"],
    "notice:apache-2.0": ["licensed under the apache license [[version]] 2 0", "under the [[terms of the]] apache license [[version]] 2 0"],
    "notice:gpl-3.0": ["under the [[terms of the]] gnu general public license [[as published by the free software foundation [[inc]]]] [[either]] version 3"],
    "notice:gpl-2.0": ["under the [[terms of the]] gnu general public license [[as published by the free software foundation [[inc]]]] [[either]] version 2"],
    "notice:cc-by-nc-4.0": ["licensed under [[a]] [[the]] cc by nc 4 0", "creative commons attribution noncommercial 4 0 international [[public]] license"],
    "notice:cc-by-4.0": ["licensed under [[a]] [[the]] cc by 4 0", "creative commons attribution 4 0 international [[public]] license"],
    "notice:all-rights-reserved": ["all rights [[are]] reserved"],
    "text:mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of {{1..6}} and associated documentation files [[the {{1..3}}]] to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of {{1..4}} and to permit persons to whom {{1..4}} is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of {{1..4}}"
    ],
    "text:bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "text:isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "text:apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use {{1..6}} except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] [[www]] apache org licenses license 2 0"
    ],
    "text:gpl": [
        "is free software [[you]] can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1..2}} of the license or at your option any later version"
    ],
    "text:mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Deterministic states are dropped beyond so many, and made again as needed.
STATES = 20_000

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\.\.(\d+)\}\}|[^\s\[\]{}]+")


class TemplateError(ValueError):
    """Markup that doesn't close, or wording that could begin or end nowhere."""


def compile_template(text: str) -> tuple[list[tuple[str | None, int]], list[list[int]], int]:
    """States with a step each (a word, or None for any word; and the state after it), states reached for nothing, and the end.

    State 0 is the start. Optional regions are left out for nothing, replaceable ones are a state for each of their words.
    """
    steps: list[tuple[str | None, int] | None] = [None]
    free: list[list[int]] = [[]]
    open_regions: list[int] = []

    def add(word: str | None) -> int:
        at = len(steps)
        steps[at - 1] = (word, at)
        steps.append(None)
        free.append([])
        return at

    ends = _MARK.sub("", text).strip()
    if ends:
        raise TemplateError(f"not markup: {ends!r} in {text[:60]!r}")
    for mark in _MARK.finditer(text):
        if mark[0] == "[[":
            open_regions.append(len(steps) - 1)
        elif mark[0] == "]]":
            if not open_regions:
                raise TemplateError(f"nothing to close in {text[:60]!r}")
            free[open_regions.pop()].append(len(steps) - 1)
        elif mark[1] is not None:
            least, most = int(mark[1]), int(mark[2])
            if least > most or most < 1:
                raise TemplateError(f"no words in {mark[0]}")
            for _ in range(least):
                add(None)
            first, made = len(steps) - 1, []
            for _ in range(most - least):
                made.append(add(None))
            for at in range(first, len(steps) - 1):
                free[at].append(len(steps) - 1)
        else:
            word = mark[0].encode().translate(WORD_BYTES).decode()
            if not word or " " in word:
                raise TemplateError(f"{mark[0]!r} is not one word")
            add(word)
    if open_regions:
        raise TemplateError(f"a region is left open in {text[:60]!r}")
    return [s or (None, -1) for s in steps], free, len(steps) - 1


class Automaton:
    """A template that reads words. Its deterministic states are sets of the template's, made when they are first needed."""

    def __init__(self, template: str):
        self.steps, self.free, self.end = compile_template(template)
        self.words = {w for w, _ in self.steps if w is not None}
        # leading words that may be anything: starts are found at the first mandatory word, and go back by so many
        self.start = self._closed({0})
        if self.end in self.start:
            raise TemplateError("a template without mandatory wording accepts everything")
        self.longest = self.end
        self._made: dict[tuple[frozenset[int], str | None], frozenset[int]] = {}

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        key = (states, word if word in self.words else None)
        found = self._made.get(key)
        if found is None:
            if len(self._made) >= STATES:
                self._made.clear()
            found = self._made[key] = self._closed({to for w, to in (self.steps[s] for s in states) if to >= 0 and (w is None or w == word)})
        return found

    def anchors(self) -> dict[str, tuple[int, int]]:
        """Words of which one is read after m to n others, whatever these are: where the automaton may have started."""
        out: dict[str, tuple[int, int]] = {}
        states, read = self.start, 0
        while True:
            for word in (self.steps[s][0] for s in states if self.steps[s][1] >= 0):
                if word is not None:
                    low, high = out.get(word, (read, read))
                    out[word] = (min(low, read), max(high, read))
            states = self._closed({to for w, to in (self.steps[s] for s in states) if to >= 0 and w is None})
            if not states:
                return out
            if self.end in states:
                raise TemplateError("a template without mandatory wording accepts everything")
            read += 1

    def accepts(self, words: list[str], at: int) -> int | None:
        """Where the wording that starts here ends for the first time, or None."""
        states = self.start
        for place in range(at, min(at + self.longest, len(words))):
            states = self.step(states, words[place])
            if not states:
                return None
            if self.end in states:
                return place + 1
        return None


class Scanner:
    """All phrases and templates over one text after another."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, size: int = PIECE):
        self.size = size
        self.automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        self.phrases: dict[str, list[tuple[str, list[str]]]] = {}
        for label, phrase in phrases.items():
            self.phrases.setdefault(phrase.split()[0], []).append((label, phrase.split()))
        self.starts: dict[str, list[tuple[str, Automaton, int, int]]] = {}
        for label, automaton in self.automata:
            for word, (low, high) in automaton.anchors().items():
                self.starts.setdefault(word, []).append((label, automaton, low, high))
        self.interesting = frozenset(self.starts) | frozenset(self.phrases)
        self.reach = max([a.longest for _, a in self.automata] + [len(p.split()) for p in phrases.values()], default=1)

    def words(self, text: bytes) -> Iterator[list[str]]:
        """The text's words in lists of some `size` bytes; a word is never cut."""
        at, rest = 0, b""
        while at < len(text):
            part = rest + text[at : at + self.size].translate(WORD_BYTES)
            at += self.size
            cut = part.rfind(b" ") + 1 if at < len(text) else len(part)
            rest = part[cut:]
            yield part[:cut].decode("utf-8", "replace").split(" ")

    def places(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
        """How many words, (label, start) of each phrase, and (label, start, end) of each template's wording, without repeats."""
        found, spans = [], set()
        words: list[str] = []
        first = 0  # the number of words[0]
        done = 0  # anchors before this one have been looked at
        lists = self.words(text)
        held = next(lists, None)
        while held is not None:
            words += [w for w in held if w]
            held = next(lists, None)
            # an anchor needs `reach` words on both sides, but for the text's ends
            upto = len(words) if held is None else max(done, len(words) - self.reach)
            for i in (done + k for k, w in enumerate(islice(words, done, upto)) if w in self.interesting):
                for label, phrase in self.phrases.get(words[i], ()):
                    if words[i : i + len(phrase)] == phrase:
                        found.append((label, first + i))
                for label, automaton, low, high in self.starts.get(words[i], ()):
                    for start in range(max(0, i - high), i - low + 1):
                        end = automaton.accepts(words, start)
                        if end is not None:
                            spans.add((label, first + start, first + end))
            gone = max(0, upto - self.reach)
            done = upto - gone
            words = words[gone:]
            first += gone
        return first + len(words), found, sorted(spans, key=lambda s: (s[1], s[2], s[0]))


KIND = "n_words bigint, phrases array<struct<label: string, start: bigint>>, matches array<struct<label: string, start: bigint, end: bigint>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, *, size: int = PIECE) -> DataFrame:
    """doc_id, n_words, phrases (label, start) and matches (label, start, end) of every document, in words from 0."""
    python_workers(docs.sparkSession)
    Scanner(templates, phrases)  # errors in the templates are raised here
    kind = docs.schema["doc_id"].dataType.simpleString()
    phrase_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, size)
        for batch in batches:
            rows = [scanner.places(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[{"label": x, "start": s} for x, s in found] for _, found, _ in rows], phrase_type),
                    pa.array([[{"label": x, "start": s, "end": e} for x, s, e in spans] for _, _, spans in rows], match_type),
                ],
                names=["doc_id", "n_words", "phrases", "matches"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {KIND}")


def digest(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(docs)
    labels = lambda column: F.array_distinct(F.transform(column, lambda p: p["label"]))
    starts = F.transform("phrases", lambda p: p["start"])
    base, own = labels("phrases"), labels("matches")
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    score = F.round(1 - F.pow(F.lit(0.5), F.size(base)) * F.pow(F.lit(0.1), F.size(own)), 9)
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, own)).alias("labels"),
        score.alias("score"),
    )


def _pattern(template: str) -> str:
    """The template as a regular expression over words that each have a blank on either side."""
    out = []
    for mark in _MARK.finditer(template):
        if mark[0] == "[[":
            out.append("(?:")
        elif mark[0] == "]]":
            out.append(")?")
        elif mark[1] is not None:
            out.append(f"(?: [^ ]+ ){{{mark[1]},{mark[2]}}}")
        else:
            out.append(f" {mark[0]} ")
    return "".join(out)


def _oracle() -> str:
    starts = lambda phrase: "[i FOR i IN range(len(w)) IF " + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split())) + "]"
    phrases = ", ".join(f"{starts(p)} AS {label}" for label, p in PHRASES.items())
    names = ", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in PHRASES)
    own = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(s, '{_pattern(t)}')" for t in ts) + f" THEN '{label}' END" for label, ts in TEMPLATES.items())
    every = " || ".join(PHRASES)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS s, {phrases} FROM d),
l AS (SELECT *, {every} AS places, [x FOR x IN [{names}] IF x IS NOT NULL] AS base, [x FOR x IN [{own}] IF x IS NOT NULL] AS own FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(base || own), ',') AS labels, round(1 - pow(0.5, len(base)) * pow(0.1, len(own)), 9) AS score
FROM l
"""


ORACLE = _oracle()
