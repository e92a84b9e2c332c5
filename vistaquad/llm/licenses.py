"""Licence scans over a positional rare-token index.

The index holds the words of licence texts and notices with their places. Of each file, its licence words of highest
inverse document frequency (over the scanned corpus) are looked up, for each template so many that the postings of a match
must agree on half its weight whatever the other words are. Each posting proposes where the template would start; the
postings are intersected by that start, and only starts on which enough of them agree are verified word by word. A label is
given if the words that stand at their places weigh enough and the template's mandatory phrases stand inside. In long
templates places may drift by some words, for names and years are filled in.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.llm.common import alnum_words, utf8

# Public licence texts and the notices by which licences are granted, as (label, text, mandatory phrase).
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("agpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general
     public license as published by the free software foundation""", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
     the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or
     agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any
     kind either express or implied see the license for the specific language governing permissions and limitations under the license""", "apache license version 2"),
    ("bsd-2-clause", "licensed under the bsd 2 clause license", "bsd 2 clause"),
    ("bsd-2-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the
     following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the
     following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the
     following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the
     copyright holders and contributors as is""", "redistributions in binary form must reproduce"),
    ("bsd-3-clause", "licensed under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd-3-clause", """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
     derived from this software without specific prior written permission""", "endorse or promote products"),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
     accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software
     and to prepare derivative works of the software""", "any person or organization"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
     license as published by the free software foundation either version 2 of the license or at your option any later version""", "either version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
     license as published by the free software foundation either version 3 of the license or at your option any later version""", "either version 3"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
     provided that the above copyright notice and this permission notice appear in all copies""", "with or without fee"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public
     license as published by the free software foundation""", "lesser general public license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
     files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
     publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
     subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
     substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
     limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or
     copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
     out of or in connection with the software or the use or other dealings in the software""", "free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
     distributed with this file you can obtain one at http mozilla org mpl 2 0""", "mozilla public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
     any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
     commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software
     must not be misrepresented you must not claim that you wrote the original software""", "must not be misrepresented"),
]
# Phrases whose places are counted, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
ACCEPT = 0.75  # of a template's IDF
LONG, DRIFT = 20, 4  # words from which on a template's places may drift, and by how many words
AGREE = 0.5  # of a template's IDF: words are looked up until the postings of a match must agree on that much, or all are
SEGMENT = 8192  # starts whose postings are intersected at a time
BLOCK = 2048  # starts that are verified at a time


def _words(text: str) -> list:
    return [w.encode() for w in text.split()]


VOCABULARY = sorted({w for _, notice, key in TEMPLATES for w in _words(notice) + _words(key)} | {w for phrase, _ in BASE for w in _words(phrase)})


def _counter(batches):
    """For each task, how many of its documents hold each licence word; the last row counts the documents."""
    index = {w: i for i, w in enumerate(VOCABULARY)}
    held = np.zeros(len(index) + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            own = index.keys() & set(alnum_words(text))
            held[[index[w] for w in own]] += 1
            held[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], ["word", "n"])


def inverse_frequencies(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """IDF of each licence word over all of docs; the counts of a fixed vocabulary come to the driver."""
    rows = docs.select(utf8(text_column)).mapInArrow(_counter, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(len(VOCABULARY) + 1)
    for r in rows:
        held[r["word"]] = r["n"]
    return np.log((held[-1] + 1) / (held[:-1] + 0.5))


class Index:
    """Words as numbers; templates with the weights of their places; postings: the places of each word in each template."""

    def __init__(self, idf: np.ndarray):
        number = {w: i for i, w in enumerate(VOCABULARY)}
        self.number = number
        self.phrases = [(np.array([number[w] for w in _words(p)]), label) for p, label in BASE]
        self.templates, self.postings, self.share = [], [], np.zeros((len(TEMPLATES), len(number)))
        for t, (label, notice, key) in enumerate(TEMPLATES):
            words = np.array([number[w] for w in _words(notice)])
            weights = np.maximum(idf[words], 1e-3)
            weights /= weights.sum()
            np.add.at(self.share[t], words, weights)
            rarest = sorted(set(words.tolist()), key=lambda w: (-idf[w], w))
            self.postings.append([(w, np.flatnonzero(words == w)) for w in rarest])
            self.templates.append((label, words, weights, np.array([number[w] for w in _words(key)])))

    @staticmethod
    def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        n = len(ids) - len(phrase) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        ok = ids[:n] == phrase[0]
        for j in range(1, len(phrase)):
            ok &= ids[j : n + j] == phrase[j]
        return np.flatnonzero(ok)

    def looked_up(self, t: int, present: np.ndarray) -> tuple:
        """The rarest words of template t that a file holds, as many as no match can lack, with their places; and what of
        their weight an alignment needs at least, if all the other words stood right."""
        words, weight = [], 0.0
        held = set(present.tolist())
        lacking = 1 - self.share[t, present].sum()
        for w, at in self.postings[t]:
            if w in held:
                words.append((w, at))
                weight += self.share[t, w]
                if lacking + weight - (1 - ACCEPT) >= AGREE:
                    break
        return words, max(lacking + weight - (1 - ACCEPT), 0.0)

    def agreed(self, ids: np.ndarray, t: int, present: np.ndarray) -> tuple:
        """Starts of template t on which postings agree, and the weight of those that do. Each posting of a word proposes
        the start that it has relative to its place; postings that propose one start are added up, and a start stays if
        they weigh what every match needs. Of no such start, that on which most weight agrees (the first of equals).

        Starts are taken SEGMENT at a time, so what is held at once doesn't grow with the file.
        """
        looked, need = self.looked_up(t, present)
        words, weights = self.templates[t][1:3]
        drift = DRIFT if len(words) >= LONG else 0
        shifts = np.arange(-drift, drift + 1)
        near = [(np.unique((np.flatnonzero(ids == w)[:, None] + shifts).ravel()), at) for w, at in looked]
        out, sums, most = [], [], (0.0, 0)
        for lo in range(-len(words) - drift, len(ids) + drift + 1, SEGMENT):
            starts, weighs = [], []
            for stands, at in near:
                for place in at.tolist():
                    a, b = np.searchsorted(stands, (lo + place, lo + place + SEGMENT))
                    if a < b:
                        starts.append(stands[a:b] - place)
                        weighs.append(np.full(b - a, weights[place]))
            if not starts:
                continue
            start, weigh = np.concatenate(starts), np.concatenate(weighs)
            order = np.argsort(start, kind="stable")
            start, weigh = start[order], weigh[order]
            first = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
            total, start = np.add.reduceat(weigh, first), start[first]
            keep = total >= need - 1e-9
            out.append(start[keep]), sums.append(total[keep])
            top = int(total.argmax())
            if total[top] > most[0]:
                most = (float(total[top]), int(start[top]))
        out, sums = np.concatenate(out), np.concatenate(sums)
        return (out, sums) if len(out) else (np.array([most[1]]), np.array([most[0]]))

    def scores(self, ids: np.ndarray, t: int, starts: np.ndarray) -> tuple:
        """The weight of the words of template t that stand at their places after each start; with drift, and without."""
        words, weights = self.templates[t][1:3]
        drift = DRIFT if len(words) >= LONG else 0
        out = []
        for lo in range(0, len(starts), BLOCK):
            at = starts[lo : lo + BLOCK, None] + np.arange(len(words))
            stands = exact = np.zeros(at.shape, bool)
            for d in range(-drift, drift + 1):
                place = at + d
                own = np.where((place >= 0) & (place < len(ids)), ids[np.clip(place, 0, len(ids) - 1)], -1) == words
                stands, exact = stands | own, own if d == 0 else exact
            out.append((stands @ weights, exact @ weights))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def scan(self, ids: np.ndarray) -> tuple:
        """ids: of each word, -1 for words of no template. Base places, base labels, spans (label, start, end, score)."""
        base, labels, spans, best = [], set(), [], 0.0
        for phrase, label in self.phrases:
            found = self.places(ids, phrase)
            if len(found):
                base.append(found)
                labels.add(label)
        present = np.unique(ids[ids >= 0])
        for t in np.flatnonzero(self.share[:, present].sum(axis=1) >= ACCEPT - 1e-9):  # others can't match
            label, words, _, key = self.templates[t]
            starts = self.agreed(ids, t, present)[0]
            score, exact = self.scores(ids, t, starts)
            best, taken = max(best, float(score.max())), np.zeros(len(ids), bool)
            beyond = DRIFT if len(words) >= LONG else 0
            for i in np.lexsort((starts, -exact, -np.round(score, 9))):
                if score[i] < ACCEPT:
                    break
                lo, hi = max(int(starts[i]), 0), min(int(starts[i]) + len(words), len(ids))
                if not taken[lo:hi].any() and len(self.places(ids[lo : hi + beyond], key)):
                    taken[lo:hi] = True
                    spans.append((label, lo, hi, min(float(score[i]), 1.0)))
        return (np.sort(np.concatenate(base)) if base else np.empty(0, np.int64)), labels, spans, min(best, 1.0)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scanner(shared):
    def run(batches):
        index = shared.value
        number = index.number
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n_words, n_base, first, last, labels, spans, score = ([] for _ in range(7))
                for text in part.column(1).to_pylist():
                    words = alnum_words(text)
                    n_words.append(len(words))
                    if number.keys().isdisjoint(words):
                        found = (np.empty(0, np.int64), (), [], 0.0)
                    else:
                        found = index.scan(np.fromiter((number.get(w, -1) for w in words), np.int64, len(words)))
                    places = found[0]
                    n_base.append(len(places))
                    first.append(int(places[0]) if len(places) else None)
                    last.append(int(places[-1]) if len(places) else None)
                    labels.append(sorted(found[1]))
                    spans.append([dict(zip(("label", "start", "end", "score"), s, strict=True)) for s in sorted(found[2])])
                    score.append(max(found[3], 1.0 if len(places) else 0.0))
                ints = [pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)]
                yield pa.RecordBatch.from_arrays([part.column(0), *ints, pa.array(labels, pa.list_(pa.string())), pa.array(spans, _SPANS), pa.array(score, pa.float64())], ["id", "n_words", "n_base", "first_word", "last_word", "base", "spans", "score"])

    return run


def licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base (labels of the phrases found), spans
    (label, start, end, score of each text or notice found; words from 0; of those of one template that overlap, the best),
    score (of the templates whose words the file holds enough of, the best alignment's among those on which enough postings
    agree, else the one's on which most do; without such templates 0; 1 if a phrase was found).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null and empty texts have no words, no
    labels and score 0. Null ids, repeated rows and empty tables are passed on; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(inverse_frequencies(docs, text_column)))  # the templates' size
    schema = f"id {dict(docs.dtypes)[id_column]}, n_words long, n_base long, first_word long, last_word long, base array<string>, spans array<struct<label:string,start:long,end:long,score:double>>, score double"
    return docs.select(F.col(id_column).alias("id"), utf8(text_column).alias("text")).mapInArrow(_scanner(shared), schema)


def licence_query(docs: DataFrame) -> DataFrame:
    """op9"""
    labels = F.array_sort(F.array_distinct(F.concat("base", "spans.label")))
    return licences(docs).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", labels).alias("labels"), "score")
