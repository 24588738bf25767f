"""License scans with a positional index of rare words.

The templates below are kept as postings: word -> (template, position). The number of documents with each
template word is counted over the whole corpus first, which ranks the words by inverse document frequency.
A file is looked up by its rarest template words only: each of their places proposes a template at a
relative position, places that propose the same alignment are intersected, and an alignment counts once
the template's mandatory phrase stands there word for word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import alnum_words, columns, texts

#: Phrases whose places are counted, and the label of each.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, licence text as it stands in files, and the mandatory phrase within it.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law dedicated to the public domain under cc0 1 0", "cc0 1 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


class Index:
    """Postings of every template's words, and for each template the words that must be looked up to find it."""

    def __init__(self, templates: list[tuple[str, list[str], list[str]]], document_frequency: dict[bytes, int], n_docs: int):
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.idf: dict[bytes, float] = {}
        self.keys: set[bytes] = set()
        for label, body, phrase in templates:
            words, need = [w.encode() for w in body], [w.encode() for w in phrase]
            at = next(i for i in range(len(words)) if words[i:i + len(need)] == need)
            number = len(self.templates)
            self.templates.append((label, words, need, at))
            for w in set(words):
                self.idf[w] = math.log((n_docs + 1) / (document_frequency.get(w, 0) + 1))
            # a file with the mandatory phrase holds the phrase's rarest word, so that word always finds the template
            rarest = max(need, key=lambda w: (self.idf[w], w))
            self.keys.add(rarest)
            for i, w in enumerate(need):
                if w == rarest:
                    self.postings[w].append((number, at + i))

    def alignments(self, words: list[bytes]) -> dict[int, list[int]]:
        """Template -> file positions of the mandatory phrase, for every place where it stands."""
        rare = self.keys.intersection(words)
        if not rare:
            return {}
        proposed: dict[tuple[int, int], int] = Counter()
        for place, word in enumerate(words):
            if word in rare:
                for number, position in self.postings[word]:
                    proposed[number, place - position] += 1
        found: dict[int, list[int]] = defaultdict(list)
        for (number, shift), votes in proposed.items():
            _, _, need, at = self.templates[number]
            start = shift + at
            # each place of the rarest word within the phrase must have proposed this same alignment
            if start >= 0 and votes == sum(p == (number, q) for q in range(at, at + len(need)) for p in self.postings[need[q - at]] if need[q - at] in rare) \
                    and words[start:start + len(need)] == need:
                found[number].append(start)
        return found

    def coverage(self, words: list[bytes], number: int, start: int) -> float:
        """Share of the template's IDF weight whose words stand at their relative positions."""
        _, body, _, at = self.templates[number]
        weights = [self.idf[w] + 1 for w in body]
        shift = start - at
        return sum(x for i, (w, x) in enumerate(zip(body, weights)) if 0 <= shift + i < len(words) and words[shift + i] == w) / sum(weights)


def _all_templates() -> list[tuple[str, list[str], list[str]]]:
    base = [(label, phrase.split(), phrase.split()) for phrase, label in BASE.items()]
    return base + [(label, body.split(), phrase.split()) for label, body, phrase in TEMPLATES]


def document_frequencies(docs: DataFrame, words: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each of ``words`` stands, and the number of documents. One row a word reaches the driver."""

    def count(batches):
        total: Counter = Counter()
        n = 0
        for batch in batches:
            for text in texts(batch, "text"):
                total.update(words.intersection(alnum_words(text)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*(w.decode() for w in total), None]), pa.array([*total.values(), n])], ["word", "n"])

    rows = columns(docs, text=text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows if r.word is not None}, next((r.n for r in rows if r.word is None), 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    ``places`` lists (label, word, coverage) of every verified alignment. ``score`` is the best coverage of a
    template, 0 without one. Null and empty texts have no words, no labels and null positions; repeated rows
    are judged one by one; an empty table gives no rows.
    """
    templates = _all_templates()
    vocabulary = {w.encode() for _, body, _ in templates for w in body}
    index = Index(templates, *document_frequencies(docs, vocabulary, text_col))
    inner = columns(docs, doc_id=id_col, text=text_col)
    kind = inner.schema["doc_id"].dataType.simpleString()
    n_base = len(BASE)

    def look(batches):
        for batch in batches:
            rows = []
            for text in texts(batch, "text"):
                words = alnum_words(text)
                found = index.alignments(words)
                base = [s for number, starts in found.items() if number < n_base for s in starts]
                labels = sorted({index.templates[number][0] for number in found})
                places = sorted((index.templates[number][0], s, index.coverage(words, number, s)) for number, starts in found.items() for s in starts)
                rows.append({
                    "n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
                    "base_labels": ",".join(sorted({index.templates[n][0] for n in found if n < n_base})), "labels": ",".join(labels),
                    "score": max((p[2] for p in places), default=0.0), "places": [dict(zip(("label", "word", "coverage"), p)) for p in places]})
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("coverage", pa.float64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)]], ["doc_id", *names])

    out = inner.mapInArrow(look, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                                 "score double, places array<struct<label: string, word: bigint, coverage: double>>")
    return out.withColumnRenamed("doc_id", id_col)
