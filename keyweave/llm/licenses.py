"""License scan by a positional rare-token index.

Template texts are indexed by word and position. Document frequencies of the templates' words
are counted over all documents, and give each word its inverse document frequency. Each place of a
template's word in the document votes with that weight for a relative position of the template;
rare words weigh most, but all words vote, as the templates' vocabulary is bounded. A relative
position with enough weight is a candidate, and counts only if the template's mandatory key
phrases stand in the document, word for word, around it.

Words are runs of ASCII letters, digits and all other non-ASCII characters, with A-Z in lower
case. Positions count words from 0.

Definitions: a null or empty text has no words, no labels and score 0; a null doc_id is kept as
null; repeated rows give repeated results; labels are sorted; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import texts_of

# The phrases that are reported at every place, and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label: (template text, mandatory key phrases). Short excerpts of public license notices.
TEMPLATES = {
    "agpl-3.0": (
        "this program is licensed under the gnu affero general public license version 3",
        ["gnu affero general public license"],
    ),
    "apache-2.0": (
        "licensed under the apache license version 2.0 you may not use this file except in compliance "
        "with the license",
        ["apache license version 2 0"],
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met neither the name of the copyright holder",
        ["redistribution and use in source and binary forms"],
    ),
    "cc-by-4.0": (
        "this work is licensed under a creative commons attribution 4.0 international license cc by 4.0",
        ["cc by 4 0"],
    ),
    "cc-by-nc-4.0": (
        "licensed under cc by nc 4.0 creative commons attribution noncommercial 4.0 international license",
        ["cc by nc 4 0"],
    ),
    "cc-by-sa-4.0": (
        "licensed under cc by sa 4.0 creative commons attribution sharealike 4.0 international license",
        ["cc by sa 4 0"],
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        ["gnu general public license version 2"],
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        ["gnu general public license version 3"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
        ["permission to use copy modify and or distribute this software"],
    ),
    "lgpl-3.0": (
        "this library is licensed under the gnu lesser general public license version 3",
        ["gnu lesser general public license"],
    ),
    "mit": (
        "released under the mit license permission is hereby granted free of charge to any person "
        "obtaining a copy of this software and associated documentation files",
        ["mit license"],
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        ["mozilla public license v 2 0"],
    ),
}

LEAST_WEIGHT = 0.1

# All bytes of words stand for themselves, A-Z in lower case, other bytes for a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split(b" ")


def _known_words(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


@dataclass
class Index:
    """The templates' words by position, their key phrases, and the word weights."""

    weights: dict[bytes, float]
    texts: dict[str, list[bytes]]
    phrases: dict[str, list[list[bytes]]]
    totals: dict[str, float]

    @classmethod
    def build(cls, templates: dict, frequencies: dict[bytes, int], documents: int) -> Index:
        texts = {label: _known_words(text) for label, (text, _) in templates.items()}
        vocabulary = {w for words in texts.values() for w in words}
        weights = {
            w: math.log((documents + 1) / (frequencies.get(w, 0) + 1)) + 1e-6 for w in sorted(vocabulary)
        }
        phrases = {label: [_known_words(p) for p in keys] for label, (_, keys) in templates.items()}
        # added up word by word like votes are, so a whole match has a share of exactly 1
        totals = {label: float(np.cumsum([0.0, *(weights[w] for w in words)])[-1]) for label, words in texts.items()}
        return cls(weights, texts, phrases, totals)

    def found(self, words: list[bytes], present: set[bytes]) -> dict[str, float]:
        """Labels whose template stands in the document, with the matched share of its weight.

        All words of a template vote, so one that stands word for word has a share of 1.
        """
        labels = [
            label for label, keys in self.phrases.items() if self.texts[label] and all(map(present.issuperset, keys))
        ]
        places = positions(words, {w for label in labels for w in self.texts[label]})
        held = {w: np.array(at, np.int64) for w, at in places.items()}
        best: dict[str, float] = {}
        for label in labels:
            size = len(self.texts[label])
            votes = np.zeros(len(words) + size)
            for place, word in enumerate(self.texts[label]):
                votes[held[word] - place + size] += self.weights[word]
            shares = np.minimum(1.0, votes / self.totals[label])
            at = np.flatnonzero(shares >= LEAST_WEIGHT)
            low = np.maximum(0, at - 2 * size)
            for phrase in self.phrases[label]:
                stands = np.fromiter(starts(words, phrase), np.int64)
                last = at + size - len(phrase)
                near = np.searchsorted(stands, low) < np.searchsorted(stands, last, side="right")
                at, low = at[near], low[near]
            if len(at):
                best[label] = float(shares[at].max())
        return best


def positions(words: list[bytes], wanted: set[bytes]) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {w: [] for w in wanted}
    for at, word in enumerate(words):
        if word in found:
            found[word].append(at)
    return found


def starts(words: list[bytes], phrase: list[bytes]) -> Iterator[int]:
    """Places where the phrase's words stand consecutively."""
    at, size = -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + size] == phrase:
                yield at
    except ValueError:
        return


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each word of the vocabulary stands, and their number.

    The vocabulary is that of the templates; each task sends one count per word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in texts_of(batch.column(0)):
                held.update(vocabulary.intersection(words_of(text)))
        pairs = [*held.items(), (b"", rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in pairs], pa.binary()), pa.array([n for _, n in pairs], pa.int64())],
            ["word", "n"],
        )

    counted = (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    held = {bytes(r["word"]): r["n"] for r in counted}
    return held, held.pop(b"", 0)


def scan(docs: DataFrame, templates: dict | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` has the labels of ``base`` and those of ``templates`` that were found; the score is the
    largest matched share of a template's weight, 0.5 at least where a base phrase stands.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = [(_known_words(p), label) for p, label in (BASE_PHRASES if base is None else base).items()]
    vocabulary = {w for text, _ in templates.values() for w in _known_words(text)}
    index = Index.build(templates, *frequencies(docs, vocabulary))
    heads = {phrase[0] for phrase, _ in phrases}
    keys = {p[0] for found in index.phrases.values() for p in found}
    phrase_words = [set(p) for found in index.phrases.values() for p in found]

    def row(text: str) -> tuple:
        words = words_of(text)
        if b"" in words:
            words = [w for w in words if w]
        present = set(words)
        places: list[int] = []
        own: set[str] = set()
        if present & heads:
            for phrase, label in phrases:
                if present.issuperset(phrase):
                    here = list(starts(words, phrase))
                    if here:
                        places += here
                        own.add(label)
        best: dict[str, float] = {}
        if present & keys and any(present.issuperset(p) for p in phrase_words):
            best = index.found(words, present)
        score = max([*best.values(), 0.5 if own else 0.0])
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(own)),
            ",".join(sorted(own | set(best))),
            float(score),
        )

    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(row, texts_of(batch.column("text"))))) or [()] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
