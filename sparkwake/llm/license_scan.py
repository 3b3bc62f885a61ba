"""License scans by template-markup matching.

A template is its wording with two kinds of region: `[[ ... ]]` is optional, `{{n}}` stands for up to n words
of any wording. Each compiles to an automaton over words; a text is accepted where the automaton, begun at the
first mandatory words, reads the mandatory wording exactly. Candidate places come from a search for those first
words, so the automaton runs only there and its run is bounded by the template.

Beside the templates there are plain phrases with labels (the base): every place where a phrase's words stand
consecutively. Words are runs of ASCII letters or digits and of any non-ASCII characters, A-Z lower-cased.

Score: 1 if a template accepts, else 0.5 if a phrase was found, else 0.

Defined cases: a null text is empty: no words, counts 0, places null, labels the empty string. Whole texts are
read. Repeated rows give repeated results; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm.common import documents, rows_to_batch, slices

#: Phrases and labels of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licenses and of their usual notices, with markup.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the [[terms of the]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software [[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability]]",
    "apache-notice": "licensed under the apache license version 2 0 [[the license you may not use {{3}} file except in compliance with the license]]",
    "gpl-notice": "licensed under the gnu general public license [[version {{1}}]]",
    "gpl-text": "free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free software foundation either version {{2}} of the license or [[at your option]] any later version",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3 neither the name of {{20}} may be used to endorse or promote products derived from this software without specific prior written permission]]",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: Bytes that no word has, A-Z lower-cased: to be given to bytes.translate.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


class Automaton:
    """Words and regions as states 0..n; `skips` are moves without a word, `any_word` states that may read any word."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        self.skips: list[tuple[int, int]] = []
        opened: list[int] = []
        first: list[bytes] = []
        in_first = True
        for item in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
            if item == "[[":
                opened.append(len(self.words))
                in_first = False
            elif item == "]]":
                self.skips.append((opened.pop(), len(self.words)))
            elif item.startswith("{{"):
                start, many = len(self.words), int(item[2:-2])
                self.words += [None] * many
                self.skips += [(start + k, start + many) for k in range(many)]
                in_first = False
            else:
                self.words.append(item.encode())
                if in_first:
                    first.append(item.encode())
        if opened or not first:
            raise ValueError(f"a template begins with mandatory words and closes its regions: {template}")
        self.anchor = b" " + b" ".join(first) + b" "

    def _reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            state = todo.pop()
            for a, b in self.skips:
                if a == state and b not in states:
                    states.add(b)
                    todo.append(b)
        return states

    def accepts(self, words: list[bytes], at: int) -> int | None:
        """Where the longest reading that begins at word `at` ends, if there is one."""
        states, end = self._reach({0}), None
        while states:
            if len(self.words) in states:
                end = at
            if at >= len(words):
                break
            word = words[at]
            states = self._reach({s + 1 for s in states if s < len(self.words) and (self.words[s] is None or self.words[s] == word)})
            at += 1
        return end


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase, with a space on either side, starts in the words joined by spaces."""
    found, at, words, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = joined.find(phrase, at + 1)
    return found


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {name: Automaton(t) for name, t in templates.items()}
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
        """Number of words; places and labels of phrases; names and word spans (end exclusive) of templates."""
        words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split(b" ")
        words = [w for w in words if w]
        joined = b" " + b" ".join(words) + b" "
        base = [(at, label) for phrase, label in self.phrases for at in places(joined, phrase)]
        spans = [(name, at, end) for name, a in self.automata.items() for at in places(joined, a.anchor) if (end := a.accepts(words, at)) is not None]
        return len(words), base, spans


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, base array<struct<word,label>>, found array<struct<name,start,end>> in words."""
    base_type, found_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", base_type), ("found", found_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for cols in slices(batches):
            rows = []
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                n, base, spans = scanner.scan(text)
                rows.append((doc_id, n, [{"word": w, "label": k} for w, k in base], [{"name": k, "start": a, "end": b} for k, a, b in spans]))
            yield rows_to_batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, base array<struct<word:long,label:string>>, found array<struct<name:string,start:long,end:long>>")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base, own = F.col("base.label"), F.col("found.name")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"), F.array_max(F.col("base.word")).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, own)).alias("labels"),
        F.when(F.size("found") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )
