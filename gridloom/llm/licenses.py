"""License scans by template matching: marked-up templates are compiled into one token automaton.

Markup: plain words are mandatory; ``[[...]]`` may be left out; ``{{n}}`` stands for one to n words of any kind. A place
of a text is accepted where its words run through a template with all mandatory wording equal.

A text's words are the maximal runs of ``0-9``, ``a-z`` and non-ASCII characters after A-Z are lower-cased. Null and
empty texts have no words, no labels and score 0; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import over_texts

#: Phrases whose places are counted, and their labels (fixed values).
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wording of common public license notices.
TEMPLATES = (
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of {{8}} and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 [[0]]"),
    ("apache-2", "you may not use {{4}} except in compliance with the license"),
    ("cc-by-nc", "licensed under [[a]] [[creative commons]] cc by nc [[{{2}}]]"),
    ("cc-by-nc", "creative commons attribution non commercial {{2}} [[international]] license"),
    ("gpl", "[[this work is]] licensed under the gnu general public license [[version {{1}}]]"),
    ("lgpl", "gnu [[lesser]] [[library]] general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v [[2 0]]"),
    ("proprietary", "all rights reserved"),
)
#: Separators become spaces and A-Z small letters; bytes from 0x80 on belong to words.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
ANY = None


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """A token automaton without empty moves: ``moves[state]`` maps a word, or ANY, to the next states."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.moves: list[dict[bytes | None, set[int]]] = []
        self.accept: dict[int, set[tuple[str, int]]] = defaultdict(set)
        self.first: dict[bytes, set[int]] = defaultdict(set)
        for label, markup in templates:
            ends, fixed = self._compile(re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup))
            for state in ends:
                self.accept[state].add((label, fixed))

    def _state(self) -> int:
        self.moves.append({})
        return len(self.moves) - 1

    def _compile(self, parts: list[str]) -> tuple[set[int], int]:
        start = self._state()
        here, opened, fixed = {start}, [], 0
        for part in parts:
            if part == "[[":
                opened.append(set(here))
            elif part == "]]":
                here = here | opened.pop()
            elif part.startswith("{{"):
                reached: set[int] = set()
                for _ in range(int(part[2:-2])):
                    here = {self._step(here, ANY)}
                    reached |= here
                here = reached
            else:
                fixed += not opened
                here = {self._step(here, part.encode())}
        for word, states in self.moves[start].items():
            if word is ANY:
                raise ValueError("a template starts with a word")
            self.first[word] |= states
        return here, fixed

    def _step(self, here: set[int], word: bytes | None) -> int:
        state = self._state()
        for h in here:
            self.moves[h].setdefault(word, set()).add(state)
        return state

    def run(self, tokens: list[bytes], at: int) -> set[tuple[str, int]]:
        """(label, mandatory words) of the templates accepted from place ``at``; ends when no state is left."""
        states, found = self.first.get(tokens[at], set()), set()
        while states:
            for s in states:
                found |= self.accept.get(s, set())
            at += 1
            if at == len(tokens):
                break
            word = tokens[at]
            states = {t for s in states for key in (word, ANY) for t in self.moves[s].get(key, ())}
        return found


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: its words, the places of the base phrases, labels, and a score.

    The score is m / (m + 4), m being the mandatory words of the longest accepted template or base phrase.
    """
    automaton = Automaton(templates)
    phrases = [(tuple(p.encode().split()), label) for p, label in base.items()]
    by_first = defaultdict(list)
    for phrase, label in phrases:
        by_first[phrase[0]].append((list(phrase), label))
    anchors = frozenset(by_first) | frozenset(automaton.first)

    def one(text: bytes):
        tokens = words(text)
        places, base_labels, found = [], set(), set()
        for i in [i for i, w in enumerate(tokens) if w in anchors]:
            for phrase, label in by_first.get(tokens[i], ()):
                if tokens[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base_labels.add(label)
                    found.add((label, len(phrase)))
            if tokens[i] in automaton.first:
                found |= automaton.run(tokens, i)
        most = max((m for _, m in found), default=0)
        edges = (min(places), max(places)) if places else (None, None)
        return len(tokens), len(places), *edges, ",".join(sorted(base_labels)), ",".join(sorted({x for x, _ in found})), most / (most + 4)

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def work(part: pa.RecordBatch):
        rows = [one(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
        return {"doc_id": part.column("doc_id"), **dict(zip(names, zip(*rows), strict=True))}

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return over_texts(docs.select("doc_id", "text"), work, schema)
