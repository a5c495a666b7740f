"""License scan: exact set-similarity join of text blocks with license templates, plus consecutive phrases.

Blocks are windows over the words of the whole text, across its line breaks, as notices are wrapped. A template of L words
is compared with the windows of 2 L words that begin at every L-th word, so each stretch of L words lies whole in one of them.
A template is found in a block when the block holds at least ``THRESHOLD`` of the template's distinct words, its numbers
(of a version) among them. Words are ordered by how often the whole corpus uses them, rarest first; a block is compared with a template only if

* prefix: one of the template's first ``|T| - need + 1`` words is in the block (a block that meets the threshold has one),
* length: the block has at least ``need`` different words of the templates,
* position: with the shared word at place i of the template and at place j of the block, both in that order, what can be
  shared is at most ``min(i, j) + 1 + min(|T| - i - 1, |B| - j - 1)``, which must reach ``need``.

Only windows around a prefix word are looked at, so texts without license words cost one search. A template's numbers and
its deciding words (``noncommercial``, ``lesser``, ...) must all be in the block, whatever the threshold.

Defined results: null or empty text has no words, no places and no labels; repeated rows give repeated results; an empty
table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
THRESHOLD = 0.9
UPPER = {c: c + 32 for c in range(65, 91)}

#: Phrase -> label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Fixed values: (label, notice or paragraph), the usual wording of public licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
]


#: Words that tell one license from another of like wording.
DECIDING = {"noncommercial", "sharealike", "lesser", "affero", "eclipse", "boost"}


def ascii_lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.translate(UPPER)


def word_counts(df: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often all texts use each word of ``vocabulary``; at most that many rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen = Counter(WORD.findall(ascii_lower(text)))
                for w in vocabulary:
                    if w in seen:
                        total[w] += seen[w]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = texts_of(df).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


class TemplateIndex:
    """Templates as word lists ordered rarest first, with an index of their prefixes. ``tried`` counts what each filter met."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float = THRESHOLD) -> None:
        self.order = {w: k for k, w in enumerate(sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w)))}
        self.sets: list[tuple[str, list[str], int, int, set[str]]] = []
        self.prefix: dict[str, list[tuple[int, int]]] = {}
        self.tried: Counter = Counter()
        for label, text in templates:
            own = text.split()
            words = sorted(set(own), key=self.order.__getitem__)
            need = math.ceil(threshold * len(words) - 1e-9)
            for at, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.sets), at))
            self.sets.append((label, words, need, len(own), {w for w in words if w.isdigit() or w in DECIDING}))

    def search(self, words: list[str]) -> Iterator[tuple[str, float]]:
        """(label, containment) for each template and window of the text that meets the threshold."""
        done, blocks = set(), {}
        for place, w in enumerate(words):
            for k, i in self.prefix.get(w, ()):
                label, own, need, step, must = self.sets[k]
                for start in {max(0, place // step - 1) * step, place // step * step}:
                    if (k, start) in done:
                        continue
                    done.add((k, start))
                    self.tried["prefix"] += 1
                    block = blocks.get((step, start))
                    if block is None:  # the block's template words by place in the order
                        held = sorted({x for x in words[start : start + 2 * step] if x in self.order}, key=self.order.__getitem__)
                        block = blocks[step, start] = {x: j for j, x in enumerate(held)}
                    if len(block) < need:
                        self.tried["length"] += 1
                        continue
                    j = block[w]
                    if min(i, j) + 1 + min(len(own) - i - 1, len(block) - j - 1) < need:
                        self.tried["position"] += 1
                        continue
                    self.tried["compared"] += 1
                    shared = sum(x in block for x in own)
                    if shared >= need and all(x in block for x in must):
                        yield label, shared / len(own)


def phrase_places(words: list[str]) -> list[tuple[int, str]]:
    places = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        rare = min(range(len(own)), key=lambda k: words.count(own[k]))  # look where the rarest of its words stands
        at = -1
        for _ in range(words.count(own[rare])):
            at = words.index(own[rare], at + 1)
            if at >= rare and words[at - rare : at - rare + len(own)] == own:
                places.append((at - rare, label))
    return sorted(places)


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, places array<struct<word,label>>, found array<struct<label,containment>>`` for every row."""
    counts = word_counts(df, {w for _, t in templates for w in t.split()})
    index = TemplateIndex(templates, counts, threshold)
    phrases = [p.split() for p in PHRASES]

    def row(doc_id, text):
        text = ascii_lower(text)
        words = WORD.findall(text)
        places = phrase_places(words) if any(all(w in text for w in p) for p in phrases) else []
        found: dict[str, float] = {}
        if any(w in text for w in index.prefix):
            for label, c in index.search(words):
                found[label] = max(c, found.get(label, 0.0))
        return doc_id, len(words), [{"word": w, "label": x} for w, x in places], [{"label": x, "containment": c} for x, c in sorted(found.items())]

    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64())]))]
    return scan(df, row, "doc_id long, n_words long, places array<struct<word:long,label:string>>, found array<struct<label:string,containment:double>>", ["doc_id", "n_words", "places", "found"], types)


def license_digest(found: DataFrame) -> DataFrame:
    base, more = F.array_distinct(F.col("places.label")), F.col("found.label")
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("found.containment"), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        score.alias("score"),
    )
