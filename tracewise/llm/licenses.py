"""Licence scanning with a positional index of rare words.

Every licence template is filed under its rarest words (by document frequency
over the whole corpus) with their positions. A file's words are looked up in
the index, highest inverse document frequency first; each hit points to the
place where the template would begin, and places where enough of the
template's rare words agree are intersected by relative position. A candidate
counts only if its mandatory phrases stand within the aligned stretch.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, map_rows, table

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Passages of public licences (several of one licence may stand alone): label, text, mandatory phrases.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted", "deal in the software without restriction")),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("as is basis", "without warranties or conditions of any kind")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("this permission notice shall be included in all copies or substantial portions",)),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ("without warranty of any kind", "merchantability fitness for a particular purpose and noninfringement")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("may not use this file except in compliance with the license",)),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details", ("in the hope that it will be useful", "gnu general public license for more details")),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu affero general public license",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", ("eclipse public license",)),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", ("altered source versions must be plainly marked as such",)),
    ("bsl", "Boost Software License - Version 1.0 - August 17th, 2003", ("boost software license version 1 0",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international license",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc0", "Released under CC0 1.0 Universal", ("cc0 1 0",)),
)
RARE_WORDS = 6
#: Share of a template's indexed weight that has to agree on one place, and drift allowed in it.
AGREEMENT, DRIFT = 0.5, 3


def words_of(text: str) -> list[bytes]:
    return alnum_words(text.encode())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    base: bool


def templates(phrases=PHRASES, passages=TEMPLATES) -> list[Template]:
    base = [Template(label, tuple(words_of(p)), (tuple(words_of(p)),), True) for p, label in phrases]
    return base + [Template(label, tuple(words_of(t)), tuple(tuple(words_of(p)) for p in must), False) for label, t, must in passages]


class Index:
    """Postings (template, position) of each template's rarest words; of a phrase, its rarest word alone."""

    def __init__(self, all_templates: list[Template], document_counts: dict[bytes, int], n_docs: int):
        self.templates = all_templates
        idf = lambda w: math.log((n_docs + 1) / (document_counts.get(w, 0) + 1)) + 1e-9
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.idf: dict[bytes, float] = {}
        self.weight: list[float] = []
        for k, t in enumerate(all_templates):
            ranked = sorted(set(t.words), key=lambda w: (-idf(w), w))[: 1 if t.base else RARE_WORDS]
            for at, w in enumerate(t.words):
                if w in ranked:
                    self.postings[w].append((k, at))
                    self.idf[w] = idf(w)
            self.weight.append(sum(idf(w) for w in t.words if w in ranked))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, own labels, score."""
        postings = self.postings
        hits = [(i, w) for i, w in enumerate(words) if w in postings]
        if not hits:
            return [], set(), set(), 0.0
        hits.sort(key=lambda h: -self.idf[h[1]])
        starts: list[int] = []
        base: set[str] = set()
        votes: dict[int, Counter] = defaultdict(Counter)
        for i, w in hits:
            for k, at in postings[w]:
                t, start = self.templates[k], i - at
                if t.base:
                    if start >= 0 and tuple(words[start : start + len(t.words)]) == t.words:
                        starts.append(start)
                        base.add(t.label)
                else:
                    votes[k][start] += self.idf[w]
        own, score = set(), 1.0 if base else 0.0
        for k, places in votes.items():
            t = self.templates[k]
            if t.label in own:
                continue
            for start in sorted(places):
                agreed = sum(places.get(start + d, 0.0) for d in range(DRIFT + 1))
                if agreed < AGREEMENT * self.weight[k]:
                    continue
                stretch = words[max(0, start - DRIFT) : max(0, start) + len(t.words) + 2 * DRIFT]
                if all(_stands(p, stretch) for p in t.phrases):
                    own.add(t.label)
                    score = max(score, min(1.0, agreed / self.weight[k]))
                    break
        return sorted(set(starts)), base, own, score


def _stands(phrase: tuple[bytes, ...], words: list[bytes]) -> bool:
    n = len(phrase)
    return any(tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """How many of all documents hold each word of the vocabulary (a bounded table), and their number."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter = Counter()
        for text in batch.column(1):
            found.update(vocabulary.intersection(alnum_words(text.as_py())))
        found[b""] = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = map_rows(docs.select(F.lit(0).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text")), lambda: step, "word binary, n long")
    rows = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return rows, rows.pop(b"", 0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, phrases=PHRASES, passages=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, columns of :data:`SCHEMA`.

    Null and empty texts have no words, no labels and score 0. Repeated rows
    are all returned; other columns are ignored; an empty table gives no rows.
    """
    known = templates(phrases, passages)
    counts, n_docs = document_counts(docs, frozenset(w for t in known for w in t.words), text_col)
    index = Index(known, counts, n_docs)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1):
            words = alnum_words(text.as_py())
            starts, base, own, score = index.scan(words)
            rows.append((len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(base | own)), score))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_rows(as_bytes(docs, id_col, text_col), lambda: lambda b: step(b) if b.num_rows else None, SCHEMA)


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
