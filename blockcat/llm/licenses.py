"""License scan by a positional index of rare words.

Templates (notices, tags and whole texts of well-known licences; a parameter) are indexed by word: each posting is a place in a
template. A first pass over all texts counts in how many each licence word occurs, which gives its IDF. In the second pass, a
file's licence words are ranked by IDF. A template comes into question by its rarest mandatory word, and stays so if all its
mandatory words are in the file and enough of its weight; then the file's highest-IDF words of it are looked up, and each
occurrence gives, by relative position, the place where the template would begin. Places that enough words agree on are
verified: the template's words are compared there, by IDF weight, and its mandatory phrases must stand where it has them.

The three base phrases go the same way, each with its rarest word as the only one to look up and all of it mandatory; as any
occurrence of the phrase has that word, all places are found.

The index is as large as the templates, so it is sent to all tasks; texts are never shuffled, and a text's cost is in
proportion to its words and the occurrences of the words looked up.

Defined cases: null and empty texts have no words and no labels; a text of any length is read whole; a repeated row is reported
as often; ties in IDF go by the word; an empty table gives an empty result (with no texts every word is equally rare); other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.llm.common import text_bytes, words

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of public licence notices, as (label, text, mandatory phrases).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance")),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("agreed to in writing", "warranties or conditions")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related rights to the public domain", ("possible under law", "public domain")),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "hereby granted")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "obtaining a copy")),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ("as is", "merchantability")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)

# Whole texts of short public licences, in lower case without signs, as (label, text, mandatory phrases).
_DISCLAIMED = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_REDISTRIBUTION = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_IS = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
TEXTS = (
    ("bsd-2-clause", f"{_REDISTRIBUTION} {_DISCLAIMED}", ("conditions are met", "are disclaimed")),
    ("bsd-3-clause", f"{_REDISTRIBUTION} {_ENDORSE} {_DISCLAIMED}", ("conditions are met", "endorse or promote", "are disclaimed")),
    ("isc", f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_AS_IS}", ("permission to use copy modify", "disclaims all warranties")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("free of charge", "substantial portions", "noninfringement")),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software", "public domain", "compiled binary")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("express or implied warranty", "alter it and redistribute it freely")),
)

# Identifiers that a licence tag may name.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")

#: Words of a template that are looked up in a file, how many must agree on a place, and the weight of its words to be found there.
ANCHORS, AGREE, WEIGHT = 6, 2, 0.6

Notice = tuple[str, str, tuple[str, ...]]


def spdx_tags(names: Iterable[str] = SPDX) -> tuple[Notice, ...]:
    """A notice for each licence tag, labelled by its identifier in lower case; all of it is mandatory."""
    tags = ((name.lower(), " ".join(["spdx license identifier", *name.lower().replace("-", " ").replace(".", " ").split()])) for name in names)
    return tuple((label, text, (text,)) for label, text in tags)


DEFAULT: tuple[Notice, ...] = (*TEMPLATES, *TEXTS, *spdx_tags())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    mandatory: tuple[tuple[int, tuple[bytes, ...]], ...]  # (position, words)
    base: bool


def _template(label: str, text: str, mandatory: tuple[str, ...], base: bool) -> Template:
    own = tuple(words(text.encode()))
    found = []
    for phrase in mandatory:
        p = tuple(words(phrase.encode()))
        found.append((next(i for i in range(len(own)) if own[i : i + len(p)] == p), p))
    return Template(label, own, tuple(found), base)


def templates_of(notices: Iterable[Notice]) -> tuple[Template, ...]:
    """The base phrases and the given notices (label, text, mandatory phrases of it: at least one)."""
    return (*(_template(label, phrase, (phrase,), True) for phrase, label in PHRASES.items()), *(_template(*n, False) for n in notices))


class Index:
    """Positions of words in templates, and templates by their rarest mandatory word; ``idf`` by word."""

    def __init__(self, idf: dict[bytes, float], templates: tuple[Template, ...]):
        self.idf, self.templates = idf, templates
        self.rank = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.places: list[dict[bytes, list[int]]] = []
        self.key: dict[bytes, list[int]] = defaultdict(list)
        self.must: list[frozenset[bytes]] = []
        for n, t in enumerate(templates):
            places: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(t.words):
                places[w].append(i)
            self.places.append(dict(places))
            self.must.append(frozenset(w for _, p in t.mandatory for w in p))
            self.key[min(self.must[n], key=self.rank.__getitem__)].append(n)
        self.weight = [sum(idf[w] for w in t.words) for t in templates]

    def _asked(self, n: int, present: set[bytes]) -> list[bytes]:
        """The file's highest-IDF words of a template that may be in it; none if it can't be."""
        if not self.must[n] <= present:
            return []
        if self.templates[n].base:
            return [min(self.must[n], key=self.rank.__getitem__)]
        own = [w for w in self.places[n] if w in present]
        if sum(self.idf[w] * len(self.places[n][w]) for w in own) < WEIGHT * self.weight[n]:
            return []
        return sorted(own, key=self.rank.__getitem__)[:ANCHORS]

    def find(self, text: list[bytes]) -> list[tuple[Template, int, float]]:
        """(template, place, share of its weight found there)."""
        present = self.rank.keys() & set(text)
        asked = {n: own for w in present & self.key.keys() for n in self.key[w] if (own := self._asked(n, present))}
        if not asked:
            return []
        at: dict[bytes, list[int]] = {w: [] for own in asked.values() for w in own}
        for i, w in enumerate(text):
            if w in at:
                at[w].append(i)
        out = []
        for n, own in asked.items():
            t, votes = self.templates[n], Counter(i - k for w in own for i in at[w] for k in self.places[n][w])
            for place, v in votes.items():
                if v < min(AGREE, len(own)) or (t.base and place < 0):
                    continue
                if all(place + i >= 0 and tuple(text[place + i : place + i + len(p)]) == p for i, p in t.mandatory):
                    share = 1.0 if t.base else sum(self.idf[w] for i, w in enumerate(t.words) if 0 <= place + i < len(text) and text[place + i] == w) / self.weight[n]
                    if share >= WEIGHT:
                        out.append((t, place, min(1.0, share)))
        return out


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and in how many of them each licence word occurs: over all rows; the result is as large as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for b in batches:
            n[b""] += b.num_rows
            for text in text_bytes(b.column("text")):
                n.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], type=pa.string()), pa.array(list(n.values()), type=pa.int64())], names=["word", "n"])

    found = {r[0].encode(): r[1] for r in docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}
    return found.pop(b"", 0), found


def scan(docs: DataFrame, notices: Iterable[Notice] = DEFAULT) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label:place of all)."""
    templates = templates_of(notices)
    vocabulary = frozenset(w for t in templates for w in t.words)
    total, counts = document_counts(docs, vocabulary)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, templates)
        for b in batches:
            rows = []
            for text in text_bytes(b.column("text")):
                own = words(text)
                found = index.find(own)
                base = [(place, t.label) for t, place, _ in found if t.base]
                labels = sorted({t.label for t, _, _ in found})
                listed = ",".join(f"{label}:{place}" for place, label in sorted((place, t.label) for t, place, _ in found))
                first, last = (min(base)[0], max(base)[0]) if base else (None, None)
                rows.append((len(own), len(base), first, last, ",".join(sorted({label for _, label in base})), ",".join(labels), max([0.0, *(s for _, _, s in found)]), listed))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string")
