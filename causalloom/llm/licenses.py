"""License scans by a positional index: rare words of phrases first, then all words of the templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base test and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices as their licences word them (label, notice, phrases that must stand in the file).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "sublicense and or sell copies"]),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ["permission notice shall be included in all copies or substantial portions of the software"]),
    ("mit", "released under the MIT License", ["the mit license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ["apache license version 2"]),
    ("apache-2", "licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES", ["2 redistributions in binary form must reproduce", "with the distribution this software is provided"]),
    ("bsd-3", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["redistributions in binary form must reproduce", "may be used to endorse or promote products derived from this software"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2 of the license"]),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu affero general public license", "version 3 of the license"]),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", ["gnu lesser general public license", "version 2 1 of the license"]),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu lesser general public license", "version 3 of the license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ["eclipse public license 2"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"]),
    ("boost-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software", ["permission is hereby granted free of charge to any person or organization", "use reproduce display distribute execute and transmit the software"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ["mozilla public license v 2"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
]

#: A word may stand this many places off its template's position.
SLACK = 2
#: Least part of a template's words, or of their IDF, that a file must have at the right places.
LEAST_SCORE = 0.6

#: Bytes of UTF-8 to bytes of words: A-Z in lower case, what is no word byte a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands; joined: the words, each between single spaces."""
    out, at = [], joined.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(at)
        at = joined.find(b" " + phrase + b" ", at + 1)
    numbers, before, last = [], 0, 0
    for at in out:
        before += joined.count(b" ", last, at)
        last = at
        numbers.append(before)
    return numbers


class Index:
    """The rarest word of each phrase -> templates, and for each template its words -> places."""

    def __init__(self, templates, idf: dict[bytes, float]):
        self.templates = [(label, words(text), [b" ".join(words(p)) for p in phrases]) for label, text, phrases in templates]
        self.idf = idf
        self.rarest = [{max(p.split(), key=lambda w: (idf.get(w, 0.0), w), default=b"") for p in phrases} for _, _, phrases in self.templates]
        self.rare = set().union(*self.rarest)
        self.postings: list[dict[bytes, list[int]]] = []
        self.weight = []
        for _, ws, _ in self.templates:
            self.weight.append(sum(idf[w] for w in ws))
            self.postings.append({})
            for q, w in enumerate(ws):
                self.postings[-1].setdefault(w, []).append(q)

    def scan(self, ws: list[bytes], joined: bytes) -> tuple[set[str], float]:
        """Labels of the templates that stand in the file, and the best alignment's score.

        A template's phrases must all stand in the file, so templates of which a phrase's
        rarest word is missing are passed over: this loses none, however common the words
        are. Around a phrase, every word of the template gives by its relative place where
        the template would start. Starts within SLACK that two words agree on (or one, if
        the template has no more) are aligned word by word; then the template's phrases
        are looked up in the aligned stretch. The score is the part of the template's IDF
        or of its words at the right places, whichever is higher.
        """
        found = self.rare.intersection(ws)
        labels, best = set(), 0.0
        for t, (label, own, phrases) in enumerate(self.templates):
            if not own or not self.rarest[t] <= found or not all(b" " + p + b" " in joined for p in phrases):
                continue
            votes = self._votes(t, ws, joined)
            need = min(2, len(self.postings[t]))
            done = None
            for s in sorted(votes):
                if done is not None and s <= done + SLACK:
                    continue  # the same stretch again
                if len({own[q] for d in range(SLACK + 1) for q in votes.get(s + d, ())}) < need:
                    continue
                hits = sorted(set().union(*(votes.get(s + d, ()) for d in range(-SLACK, 2 * SLACK + 1))))
                score = len(hits) / len(own)
                if self.weight[t]:
                    score = max(score, sum(self.idf[own[q]] for q in hits) / self.weight[t])
                if score < LEAST_SCORE:
                    continue
                lo, hi = max(0, s - 2 * SLACK), max(0, s + len(own) + 3 * SLACK)
                stretch = b" " + b" ".join(ws[lo:hi]) + b" "
                if all(b" " + p + b" " in stretch for p in phrases):
                    labels.add(label)
                    best, done = max(best, score), s
        return labels, min(1.0, best)

    def _votes(self, t: int, ws: list[bytes], joined: bytes) -> dict[int, set[int]]:
        """Starts of template t -> the template's places that speak for them, around each place of its first phrase (or in the whole file, if it has none)."""
        _, own, phrases = self.templates[t]
        reach = len(own) + 8 * SLACK
        ranges = [(p - reach, p + reach + 1) for p in places(joined, phrases[0])] if phrases else [(0, len(ws))]
        votes: dict[int, set[int]] = {}
        upto = 0
        for lo, hi in ranges:
            for i in range(max(lo, upto), min(hi, len(ws))):
                for q in self.postings[t].get(ws[i], ()):
                    votes.setdefault(i - q, set()).add(q)
            upto = max(upto, hi)
        return votes


def scan_licenses(docs: DataFrame, templates=None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in every whole text.

    A first pass counts in how many documents each word of the templates stands (as many
    sums as the templates have words); this gives the IDF over all documents. The second
    pass looks up the rarest word of each phrase, aligns templates and verifies phrases.
    An alignment counts at LEAST_SCORE of a template's IDF or of its words, so a file that
    has that part of the words keeps its label however large or uniform the table is.

    Returns doc_id, n_words, n_base (places of all base phrases), first_word, last_word
    (smallest and largest start, words from 0; null if none), base_labels, labels (base
    ones and those of templates; sorted, comma-joined), score (of the best alignment;
    1 at least where a base phrase stands). Null and empty texts have no words and empty
    labels. Repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows. Nothing is shuffled but the word counts.
    """
    templates = TEMPLATES if templates is None else templates
    base = BASE_PHRASES if base is None else base
    vocabulary = {w for _, text, _ in templates for w in words(text)}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *seen], pa.binary()), "n": pa.array([n, *seen.values()], pa.int64())})

    sums = {bytes(r["word"]): r["n"] for r in rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = sums.get(b"", 0)
    idf = {w: math.log((total + 1) / (sums.get(w, 0) + 1)) for w in vocabulary}
    phrases = [(b" ".join(words(p)), label) for p, label in base.items()]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                ws = words(text)
                joined = b" " + b" ".join(ws) + b" "
                at, mine = [], set()
                for phrase, label in phrases:
                    if got := places(joined, phrase):
                        at += got
                        mine.add(label)
                more, score = index.scan(ws, joined)
                for col, x in zip(out, (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(mine)), ",".join(sorted(mine | more)), 1.0 if mine else score), strict=True):
                    col.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(scan, schema)
