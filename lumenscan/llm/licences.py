"""Licence scans with a positional index of rare words.

Templates are licence texts and notices; the index maps each of their words to its postings,
(template, position). How rare a word is comes from the corpus itself: one pass counts, over all
documents, in how many each licence word stands. A template can only stand in a file that has
all words of its mandatory key phrases. Of such a file the scan takes the licence words of highest IDF
that the template shares, looks up their postings and intersects them by relative position:
postings whose file position less template position agree, up to a few inserted or lost words, make a
candidate if at least two words do. A candidate must hold its key phrases, and is scored by
the longest common run of words in order, weighted by IDF.

Phrases are templates of which every word is looked up and must agree exactly, so each of their
places is found. Both passes are scans without a shuffle of texts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Bytes that are no part of a word become a space, A-Z become lower case.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    whole: bool = False  # a phrase: all its words must match


# The phrases of the base result and their labels.
PHRASES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
)

# Public licence notices.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted free of charge",)),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and or modify it", "gnu general public license")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("epl", "made available under the terms of the Eclipse Public License", ("eclipse public license",)),
)


# Public licence texts in full.
TEXTS = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("copies or substantial portions of the software", "without warranty of any kind")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("permission notice appear in all copies", "the author disclaims all warranties")),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution.""", ("altered source versions must be plainly marked",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered software released into the public domain",)),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2 0", "in compliance with the license")),
)


def _at(words: list[bytes], phrase: list[bytes]) -> bool:
    """Whether the phrase's words stand together somewhere."""
    i, n = -1, len(phrase)
    try:
        while True:
            i = words.index(phrase[0], i + 1)
            if words[i : i + n] == phrase:
                return True
    except ValueError:
        return False


class Index:
    """Postings of the templates' words, and the IDF of each over the corpus. ``rare``: how many shared words of
    highest IDF are looked up for each template of several sentences or notices."""

    def __init__(self, templates: tuple[Template, ...], df: Mapping[bytes, int], n_docs: int, rare: int = 12):
        self.templates, self.rare = templates, rare
        self.words = [words_of(t.text) for t in templates]
        self.keys = [[words_of(k) for k in t.keys] for t in templates]
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 0.5)) + 0.1 for ws in self.words for w in ws}
        self.order = [sorted(set(ws), key=lambda w: (-self.idf[w], w)) for ws in self.words]  # equal IDF: by the word
        self.must = [frozenset(w for key in keys for w in key) for keys in self.keys]
        self.postings: list[dict[bytes, np.ndarray]] = []  # of each template: word -> positions
        self.gate: dict[bytes, list[int]] = defaultdict(list)  # rarest key word -> templates
        for t, ws in enumerate(self.words):
            own: dict[bytes, list[int]] = defaultdict(list)
            for p, w in enumerate(ws):
                own[w].append(p)
            self.postings.append({w: np.array(p) for w, p in own.items()})
            self.gate[max(self.must[t], key=lambda w: (self.idf[w], w))].append(t)
        self.gates = frozenset(self.gate)
        self.total = [sum(self.idf[w] for w in ws) for ws in self.words]

    def looked_up(self, t: int, here: frozenset[bytes]) -> list[bytes]:
        """The file's words of highest IDF that the template shares; all of a phrase."""
        shared = [w for w in self.order[t] if w in here]
        return shared if self.templates[t].whole else shared[: self.rare]

    def alignments(self, t: int, chosen: list[bytes], places: Mapping[bytes, np.ndarray]) -> list[tuple[int, int]]:
        """Runs (lo, hi) of relative positions on which looked-up words agree."""
        at = [(places[w][:, None] - self.postings[t][w]).ravel() for w in chosen]
        which = np.concatenate([np.tile(self.postings[t][w], len(places[w])) for w in chosen])
        shift = np.concatenate(at)
        by = np.argsort(shift, kind="stable")
        shift, which = shift[by], which[by]
        n = len(self.words[t])
        if self.templates[t].whole:
            value, count = np.unique(shift, return_counts=True)
            return [(d, d) for d in value[count == n].tolist()]
        slack, out, i = 3 + n // 8, [], 0
        names = [self.words[t][p] for p in which.tolist()]
        values = shift.tolist()
        while i < len(values):
            j = i + 1
            while j < len(values) and values[j] - values[i] <= slack:
                j += 1
            if len(set(names[i:j])) >= min(2, len(chosen)) and (len(chosen) > 1 or len(self.order[t]) == 1):
                out.append((values[i], values[j - 1]))
                i = j
            else:
                i += 1
        return out

    def match(self, words: list[bytes], t: int, lo: int, hi: int) -> float:
        """The share of the template, by IDF, that stands in order near lo to hi; 0 unless its key phrases do."""
        own = self.words[t]
        slack = 3 + len(own) // 8
        near = words[max(0, lo - slack) : max(0, hi + len(own) + slack)]
        if not all(_at(near, key) for key in self.keys[t]):
            return 0.0
        numbers = {w: k for k, w in enumerate(set(near))}
        there = np.array([numbers[w] for w in near])
        best = np.zeros(len(near) + 1)
        for w in own:
            if w in numbers:
                more = best.copy()
                more[1:] = np.maximum(more[1:], best[:-1] + self.idf[w] * (there == numbers[w]))
                best = np.maximum.accumulate(more)
        return float(best[-1]) / self.total[t]

    def scan(self, words: list[bytes], least: float) -> list[tuple[int, int, float]]:
        """(template, start, score), by template and start; of runs that overlap by a fifth the better, of equal ones the first."""
        here = frozenset(words)
        templates = sorted(t for w in self.gates & here for t in self.gate[w] if self.must[t] <= here)
        if not templates:
            return []
        chosen = {t: self.looked_up(t, here) for t in templates}
        wanted = frozenset(w for ws in chosen.values() for w in ws)
        found: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, w in enumerate(words):
            if w in wanted:
                found[w].append(i)
        places = {w: np.array(p) for w, p in found.items()}
        out = []
        for t in templates:
            last: tuple[int, int, float] | None = None
            for lo, hi in self.alignments(t, chosen[t], places):
                score = 1.0 if self.templates[t].whole else self.match(words, t, lo, hi)
                if score < least:
                    continue
                if last is not None and not self.templates[t].whole and lo - last[1] < 0.8 * len(self.words[t]):
                    last = (t, lo, score) if score > last[2] else last
                    out[-1] = last
                else:
                    last = (t, lo, score)
                    out.append(last)
        return out


def document_frequency(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all of them. The result has a row for each
    licence word; each partition sends its own counts only."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))

    def count(batches):
        seen, n = dict.fromkeys(vocabulary, 0), 0
        for b in batches:
            for t in b["text"]:
                n += 1
                for w in vocabulary.intersection(words_of(t)):
                    seen[w] += 1
        yield pd.DataFrame({"word": [None, *seen], "n": [n, *seen.values()]})

    got = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"] and bytes(r["word"]): r["n"] for r in got}
    return counts, counts.pop(None, 0) or 0


def build_index(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES + TEXTS, text_col: str = "text") -> Index:
    common.small_batches(docs.sparkSession)
    return Index(templates, *document_frequency(docs, templates, text_col))


MATCH = "struct<n_words:bigint,places:array<struct<label:string,start:bigint>>,notices:array<struct<label:string,start:bigint,n_words:int,score:double>>>"


def scan(docs: DataFrame, index: Index, *, text_col: str = "text", name: str = "licences", least: float = 0.75) -> DataFrame:
    """``docs`` with a struct: n_words, places of the phrases, and notices (label, start, words, score of at
    least ``least``). Null text counts as empty and has neither; repeated rows give equal rows, an empty table
    none, and a column that has the struct's name keeps it (the struct gets another)."""
    common.small_batches(docs.sparkSession)
    (name,) = common.fresh(docs, name)

    @F.pandas_udf(MATCH)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            places, notices = [], []
            for k, start, score in index.scan(words, least):
                own = index.templates[k]
                if own.whole:
                    places.append({"label": own.label, "start": start})
                else:
                    notices.append({"label": own.label, "start": max(0, start), "n_words": len(index.words[k]), "score": min(1.0, score)})
            rows.append((len(words), places, notices))
        return pd.DataFrame(rows, columns=["n_words", "places", "notices"])

    return docs.withColumn(name, find(F.col(text_col)))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, build_index(docs)).drop("text")
    places, notices = F.col("licences.places"), F.col("licences.notices")
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label)))
    own = F.transform(notices, lambda p: p.label)
    score = F.greatest(F.when(F.size(places) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(notices, lambda p: p.score)), F.lit(0.0)))
    starts = F.transform(places, lambda p: p.start)
    return found.select(
        "doc_id", F.col("licences.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"), score.alias("score"))


def licence_phrases(spark, sf_dir: str) -> DataFrame:
    """The places of the base phrases alone."""
    return op2(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


PHRASES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, list_filter(range(len(ws)), lambda i: ws[i + 1] = 'mit' AND ws[i + 2] = 'license') AS m,
      list_filter(range(len(ws)), lambda i: ws[i + 1] = 'apache' AND ws[i + 2] = 'license') AS a,
      list_filter(range(len(ws)), lambda i: ws[i + 1] = 'general' AND ws[i + 2] = 'public' AND ws[i + 3] = 'license') AS g FROM w)
SELECT doc_id, n_words, len(m) + len(a) + len(g) AS n_base, list_min(m || a || g) AS first_word, list_max(m || a || g) AS last_word,
       array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p
"""
