"""License scans by template-markup matching.

A template is license wording with markup: ``[[ ... ]]`` may be absent and ``{{n}}`` stands for up to n words of
any kind. Each template is compiled to a token automaton that accepts a stretch of words only if all of its
mandatory wording is there, word for word. Short phrases are counted beside it.

Defined results: a template without mandatory wording matches nothing; a null text is empty; an empty text has no words, no labels and score 0; equal rows give equal
rows; an empty table gives an empty result; other columns are ignored; very long texts are read whole, one at a
time.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliogrid.llm.common import table

# Short phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license wordings as templates.
TEMPLATES = {
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this [[file]] {{2}} except in compliance with the license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-notice": "licensed under [[the terms of]] the apache license version 2 [[0]]",
    "bsd-permission": "redistribution and use [[of this software]] in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under [[the]] [[creative commons]] cc by nc [[4 0]]",
    "gpl-header": "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {{1}} of the license or [[at your option]] any later version",
    "gpl-notice": "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] version {{1}}",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-notice": "released under [[the terms of]] the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {{1}} to deal in the {{1}} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: A-Z to a-z; letters, digits and all bytes from 0x80 stay; anything else separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Automaton:
    """Nondeterministic token automaton of one template; state ``len(words)`` accepts."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []  # None: any word
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if part == "[[":
                opened.append(len(self.words))
            elif part == "]]":
                self.skips.setdefault(opened.pop(), []).append(len(self.words))
            elif part.startswith("{{"):
                first, n = len(self.words), int(part[2:-2])
                self.words += [None] * n
                for i in range(first, first + n):
                    self.skips.setdefault(i, []).append(first + n)
            else:
                self.words.append(part.encode())
        # the words with which a match may begin; None: any
        self.firsts = {self.words[i] for i in self.closed({0}) if i < len(self.words)}
        # the longest word that no region lets skip; a text without it has no match
        optional = {i for at, ends in self.skips.items() for i in range(at, max(ends))}
        self.least = max((w for i, w in enumerate(self.words) if w and i not in optional), key=len, default=b"")

    def closed(self, states: set[int]) -> set[int]:
        """The states with all that optional regions let them reach."""
        todo, out = list(states), set(states)
        while todo:
            for to in self.skips.get(todo.pop(), ()):
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return out

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether some stretch that begins at ``start`` holds all mandatory wording."""
        states = self.closed({0})
        for i in range(start, len(words) + 1):
            if len(self.words) in states:
                return True
            if i == len(words):
                break
            states = self.closed({s + 1 for s in states if s < len(self.words) and self.words[s] in (None, words[i])})
            if not states:
                break
        return False


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(t)) for label, t in templates)


def places(words: list[bytes], some: set[bytes | None]) -> list[int]:
    return [i for i, w in enumerate(words) if w in some] if None not in some else list(range(len(words)))


def scan(raw: bytes, phrases: dict[str, str], automata) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score`` of one text."""
    folded = raw.translate(FOLD)
    words = folded.split()
    starts, base, labels = [], set(), set()
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        if not all(p in folded for p in parts):
            continue
        found = [i for i in places(words, {parts[0]}) if words[i : i + len(parts)] == parts]
        starts += found
        base |= {label} if found else set()
    for label, automaton in automata:
        if automaton.least and automaton.least in folded and any(automaton.accepts(words, i) for i in places(words, automaton.firsts)):
            labels.add(label)
    score = 1.0 if labels else 0.5 if base else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


SHOWN = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, phrase places, labels and score (1 template, 0.5 phrase only, 0 none). An identifier that is named like one of these columns is refused."""
    if id_col in SHOWN:
        raise ValueError(f"the identifier must not be named like an output column: {id_col}")
    phrases = PHRASES if phrases is None else phrases
    rules = tuple((TEMPLATES if templates is None else templates).items())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automata = compiled(rules)
        for batch in batches:
            out = list(zip(*(scan(raw or b"", phrases, automata) for raw in batch.column(1).cast(pa.binary()).to_pylist()), strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], [id_col, *SHOWN])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
