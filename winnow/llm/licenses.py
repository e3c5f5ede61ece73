"""Licence scanning with a positional index of rare licence words.

Templates are word sequences, each with a mandatory key phrase (a base phrase is its own). The index has a posting
(template, position) for each word of each key phrase. How rare a licence word is, is counted over all documents. A
file's lookups are its own licence words of the highest IDF, ``LOOKUPS`` of them and, for a template whose key phrase
the file has all words of but none among these, the rarest word of that phrase too. Each place of a lookup in the file
brings its postings, which propose where key phrases begin; a proposal stays if all of the file's lookups that the
phrase holds agree on it by their relative positions, and counts when the phrase stands there word for word.

A phrase can't stand in a file that lacks one of its words, and in any other file it has a lookup that every place of
it holds. So every place is found, whatever words are rare and whatever else of the template is there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.shared import map_batches
from winnow.llm.textscan import ALPHANUMERIC, Words, blocks

#: Licence words, those of the highest IDF, that a file looks up in any case.
LOOKUPS = 8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: The mandatory key phrase, as a range of the words.
    key: tuple[int, int]
    base: bool = False


def _base(label: str, phrase: str) -> Template:
    words = tuple(phrase.split())
    return Template(label, words, (0, len(words)), True)


def _text(label: str, key: str, text: str) -> Template:
    words, k = tuple(text.split()), key.split()
    at = next(i for i in range(len(words)) if list(words[i : i + len(k)]) == k)
    return Template(label, words, (at, at + len(k)))


#: The phrases of the base labels, opening sentences of public licence texts, and whole such texts or notices.
TEMPLATES = (
    _base("mit", "under the mit license"),
    _base("apache-2", "apache license version 2"),
    _base("cc-by-nc", "cc by nc"),
    _text("mit-grant", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    _text("isc-grant", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    _text("bsd-conditions", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    _text("apache-2-notice", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    _text("gpl-notice", "gnu general public license as published by", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    _text("lgpl-notice", "gnu lesser general public license", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    _text("mpl-2-notice", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    _text("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    _text("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    _text("mit-text", "the above copyright notice and this permission notice shall be included in all copies", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software"""),
    _text("isc-text", "provided that the above copyright notice and this permission notice appear in all copies", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
        notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
        damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising
        out of or in connection with the use or performance of this software"""),
    _text("bsd-text", "redistributions of source code must retain the above copyright notice this list of conditions", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form
        must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
        the distribution"""),
    _text("bsd-3-clause", "may be used to endorse or promote products derived from this software", """
        neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission"""),
    _text("bsd-disclaimer", "this software is provided by the copyright holders and contributors as is", """
        this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any
        direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use
        data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence
        or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    _text("apache-2-text", "distributed on an as is basis without warranties or conditions of any kind", """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the
        license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license"""),
    _text("gpl-text", "this program is distributed in the hope that it will be useful", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
        foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without
        any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
        you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"""),
    _text("agpl-notice", "gnu affero general public license", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    _text("mpl-2-text", "if a copy of the mpl was not distributed with this file", """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain
        one at https mozilla org mpl 2 0"""),
    _text("zlib-text", "altered source versions must be plainly marked as such", """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use
        of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute
        it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original
        software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source
        versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any
        source distribution"""),
    _text("boost-1", "boost software license version 1 0", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at https www boost org license 1 0 txt"),
    _text("unlicense-text", "anyone is free to copy modify publish use compile sell or distribute this software", """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
    _text("cc0", "waived all copyright and related or neighboring rights", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    _text("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    _text("cc-by-nc-notice", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    _text("epl-2-notice", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    _text("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license terms and conditions for copying distribution and modification you just do what the fuck you want to"),
)


class Vocabulary:
    """The licence words: a word hash becomes a number from 0, or -1 for any other word."""

    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for w in t.words})
        hashes = Words(pa.array(self.words), ALPHANUMERIC).hashes()
        order = np.argsort(hashes)
        self._hashes, self._number = hashes[order], order
        self._seen = np.zeros(1 << 16, dtype=bool)
        self._seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
        self.number = {w: i for i, w in enumerate(self.words)}

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int32)
        maybe = np.flatnonzero(self._seen[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self._hashes, hashes[maybe]), len(self._hashes) - 1)
        same = self._hashes[at] == hashes[maybe]
        out[maybe[same]] = self._number[at[same]]
        return out


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each licence word, over all of ``docs``.

    A row a licence word and task is exchanged; the licence words, a fixed list, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n, found = Vocabulary(templates), 0, Counter()
        for batch in batches:
            for part in blocks(batch):
                words = Words(part.column(0), ALPHANUMERIC)
                number = vocabulary(words.hashes())
                own = number >= 0
                pairs = np.unique(words.doc[own] * len(vocabulary.words) + number[own])
                found.update(dict(zip(*np.unique(pairs % len(vocabulary.words), return_counts=True), strict=True)))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["", *(vocabulary.words[i] for i in found)]), pa.array([n, *found.values()], pa.int64())], names=["word", "n"])

    rows = map_batches(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def inverse_frequencies(n_docs: int, counts: dict[str, int]) -> dict[str, float]:
    return {w: log((n_docs + 1) / (c + 1)) for w, c in counts.items()}


class Index:
    """The postings of all key phrases, and each template's words as numbers."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]):
        self.templates, self.vocabulary = templates, Vocabulary(templates)
        vocabulary, n = self.vocabulary.words, len(self.vocabulary.words)
        self.numbers = [np.array([self.vocabulary.number[w] for w in t.words]) for t in templates]
        #: Numbers of words, the rarest first; one that no document holds is looked up by none.
        self.order = np.array(sorted(range(n), key=lambda i: (-idf.get(vocabulary[i], float("inf")), i)))
        rank = np.argsort(self.order)
        #: How often each template's key phrase has each word; its length; its rarest word; its words, filled up by -1.
        self.holds = np.zeros((len(templates), n), np.float32)
        self.length = np.array([t.key[1] - t.key[0] for t in templates])
        self.low = np.array([t.key[0] for t in templates])
        self.phrase = np.full((len(templates), int(self.length.max())), -1, np.int32)
        for k, t in enumerate(templates):
            own = self.numbers[k][slice(*t.key)]
            np.add.at(self.holds[k], own, 1)
            self.phrase[k, : len(own)] = own
        self.rarest = np.array([min(p[p >= 0].tolist(), key=rank.__getitem__) for p in self.phrase])
        # By number of the word: (template, position in its key phrase).
        template, position = np.nonzero(self.phrase >= 0)
        word = self.phrase[template, position]
        by = np.argsort(word, kind="stable")
        self.first, self.of, self.at = np.searchsorted(word[by], np.arange(n + 1)), template[by], position[by]

    def lookups(self, number: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """By document and licence word, whether it is looked up; by document and template, whether all words of the key phrase are there."""
        has = np.zeros((n, len(self.order)), bool)
        own = number >= 0
        has[doc[own], number[own]] = True
        possible = has.astype(np.float32) @ (self.holds > 0).T.astype(np.float32) == (self.holds > 0).sum(axis=1)
        chosen = np.zeros_like(has)
        some = np.flatnonzero(possible.any(axis=1))
        ranked = has[some][:, self.order]
        ranked &= np.cumsum(ranked, axis=1) <= LOOKUPS
        chosen[some[:, None], self.order[None, :]] = ranked
        row, template = np.nonzero(possible & (chosen.astype(np.float32) @ self.holds.T == 0))
        chosen[row, self.rarest[template]] = True
        return chosen, possible

    def places(self, number: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(template, word position) of each place where a template's key phrase stands in one document."""
        chosen, possible = self.lookups(number, doc, n)
        place = np.flatnonzero(number >= 0)
        place = place[chosen[doc[place], number[place]]]
        word = number[place]
        size = self.first[word + 1] - self.first[word]
        posting = np.arange(int(size.sum())) + np.repeat(self.first[word] - (np.cumsum(size) - size), size)
        place, template = np.repeat(place, size), self.of[posting]
        begin = place - self.at[posting]
        fits = (begin >= 0) & (begin + self.length[template] <= len(number))
        place, template, begin = place[fits], template[fits], begin[fits]
        fits = (doc[begin] == doc[place]) & (doc[begin + self.length[template] - 1] == doc[place]) & possible[doc[place], template]
        # The intersection: a place is proposed by each lookup of the file that the key phrase holds.
        code, agree = np.unique(template[fits] * (len(number) + 1) + begin[fits], return_counts=True)
        template, begin = code // (len(number) + 1), code % (len(number) + 1)
        asked = (chosen.astype(np.float32) @ self.holds.T)[doc[begin], template] if len(code) else agree
        template, begin = template[agree == asked], begin[agree == asked]
        for i in range(self.phrase.shape[1]):
            word = self.phrase[template, i]
            stands = (word < 0) | (number[np.minimum(begin + i, len(number) - 1)] == word)
            template, begin = template[stands], begin[stands]
        return template, begin

    def matched(self, number: np.ndarray, doc: np.ndarray, k: int, begin: np.ndarray) -> np.ndarray:
        """The share of template ``k``'s words that stand at their places around each key phrase, in the same document."""
        own = self.numbers[k]
        place = begin[:, None] - self.low[k] + np.arange(len(own))[None, :]
        inside = (place >= 0) & (place < len(number))
        place = np.where(inside, place, 0)
        return (inside & (number[place] == own[None, :]) & (doc[place] == doc[begin][:, None])).mean(axis=1)


def _found(part: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    words = Words(part.column(1), ALPHANUMERIC)
    number, n = index.vocabulary(words.hashes()), part.num_rows
    n_base, low, high, score = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64), np.zeros(n)
    base: list[set[str]] = [set() for _ in range(n)]
    labels: list[set[str]] = [set() for _ in range(n)]
    template, begin = index.places(number, words.doc, n)
    for k in np.unique(template).tolist():
        t, own = index.templates[k], begin[template == k]
        doc = words.doc[own]
        np.maximum.at(score, doc, index.matched(number, words.doc, k, own))
        for i in set(doc.tolist()):
            labels[i].add(t.label)
            if t.base:
                base[i].add(t.label)
        if t.base:
            np.add.at(n_base, doc, 1)
            np.minimum.at(low, doc, own - words.first[doc])
            np.maximum.at(high, doc, own - words.first[doc])
    none = n_base == 0
    columns = {
        "doc_id": part.column(0), "n_words": pa.array(np.diff(words.first)), "n_base": pa.array(n_base),
        "first_word": pa.array(low, mask=none), "last_word": pa.array(high, mask=none),
        "base_labels": pa.array([",".join(sorted(x)) for x in base]), "labels": pa.array([",".join(sorted(x)) for x in labels]), "score": pa.array(score),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no labels and a score of 0; repeated rows are scanned as often as they come.
    ``score`` is the largest share of a found template's words that stand in their places: 1 where a base phrase was found.
    """
    n, counts = document_frequencies(docs, templates)
    index = Index(templates, inverse_frequencies(n, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield _found(part, index)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
