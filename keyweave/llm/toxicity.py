"""Toxicity scores from a learned lexicon, matched by Levenshtein automata.

A lexicon of words and stems that mark toxic documents is learned from labelled rows: terms whose
share of toxic documents is beyond chance by a likelihood ratio. The terms form a trie. A word is
matched by running the Levenshtein automaton of up to two edits against the trie: a state is the
set of trie nodes in reach, with the edits spent, and is determinised when first entered, so
misspelled terms cost as much as right ones. Windows around each hit tell quotation (quotation
marks, words of reporting) from abuse (words of address), and a logistic model of the hits of
both kinds gives the score.

Learning uses at most ``MOST_LABELS`` labelled rows, picked by a hash of their ids; the lexicon is
learned from three fourths of them, the weights from the rest. Scores depend on the text alone.

Definitions: a null text counts as empty and has the score of a text without hits; rows without
a doc_id are scored and never learned from; several labels of one document count as toxic if one
does; repeated rows give repeated results; without labelled rows of both kinds all scores are 0; an
empty table gives an empty result. ``keep_clean`` carries all columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import Recent, in_slices, texts_of

MOST_LABELS = 20_000
LEXICON_SIZE = 1_000
LEAST_SUPPORT = 4
LEAST_RATIO = 24.0
STEMS = range(4, 9)
WINDOW = 6
CACHED_WORDS = 150_000

WORD = re.compile(r"[^\W_]+")
OPENING = "\"“„«‘‹"
CLOSING = "\"”“»’›"

# Words near a hit that speak for a quotation, and those that address someone.
REPORTING = frozenset(
    "said says wrote writes called quote quoted quotes word term sagte schrieb nannte zitat wort "
    "dit disait écrit mot citation dijo escribió palabra cita".split()
)
ADDRESS = frozenset("you your yours youre du dich dir dein ihr euch tu te toi vous ton votre tú ti tus usted".split())

FEATURES = ("hits", "quoted", "density", "weight", "addressed")
# What an edit leaves of a term's weight, and the share of clean documents with misspellings of a
# term above which it is matched exactly only.
EDIT_FACTOR = 0.8
MOST_COLLISIONS = 0.0005


class Trie:
    """Terms letter by letter; ``limits`` are the most edits any term below a node allows."""

    def __init__(self, terms: list[tuple[str, bool]], allowed: list[int]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.limits = [0]
        self.words: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        self.allowed = allowed
        for number, (term, stem) in enumerate(terms):
            node, edits = 0, self.allowed[number]
            self.limits[0] = max(self.limits[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.limits.append(0)
                node = self.children[node][letter]
                self.limits[node] = max(self.limits[node], edits)
            (self.stems if stem else self.words)[node] = number


class State:
    """Trie nodes in reach with the edits spent, and the best stem passed: (edits, term) or None."""

    __slots__ = ("reach", "stem", "next", "match")

    def __init__(self, reach: tuple, stem: tuple[int, int] | None, match: tuple[int, int] | None) -> None:
        self.reach, self.stem, self.match = reach, stem, match
        self.next: dict[str, State] = {}


class Matcher(Recent):
    """The term a word is: (term number, edits), or () for none. Looked up like a dictionary."""

    def __init__(self, trie: Trie) -> None:
        super().__init__(CACHED_WORDS)
        self.trie = trie
        self.states: dict[tuple, State] = {}
        self.start = self.state({0: 0}, None)

    def state(self, reach: dict[int, int], stem: tuple[int, int] | None) -> State:
        """The state of a set of nodes, with those added that letters left out lead to."""
        trie = self.trie
        todo = list(reach.items())
        while todo:
            node, edits = todo.pop()
            if reach[node] < edits:
                continue
            for child in trie.children[node].values():
                if edits + 1 <= trie.limits[child] and edits + 1 < reach.get(child, 9):
                    reach[child] = edits + 1
                    todo.append((child, edits + 1))
        match = stem
        for node, edits in reach.items():
            for number, whole in ((trie.stems.get(node), False), (trie.words.get(node), True)):
                if number is None or edits > trie.allowed[number]:
                    continue
                hit = (edits, number)
                if match is None or hit < match:
                    match = hit
                if not whole and (stem is None or hit < stem):
                    stem = hit
        key = (tuple(sorted(reach.items())), stem)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(key[0], stem, match)
        return found

    def follow(self, state: State, letter: str) -> State:
        trie = self.trie
        reach: dict[int, int] = {}

        def reached(node: int, edits: int) -> None:
            if edits <= trie.limits[node] and edits < reach.get(node, 9):
                reach[node] = edits

        for node, edits in state.reach:
            for other, child in trie.children[node].items():
                reached(child, edits if other == letter else edits + 1)
            reached(node, edits + 1)
        target = state.next[letter] = self.state(reach, state.stem)
        return target

    def __missing__(self, word: str) -> tuple:
        hit = self.older.get(word)
        if hit is None:
            state = self.start
            for letter in word:
                state = state.next.get(letter) or self.follow(state, letter)
                if not state.reach:
                    break
            hit = (state.match[1], state.match[0]) if state.match is not None else ()
            if len(self.states) > CACHED_WORDS:
                self.states.clear()
                self.start = self.state({0: 0}, None)
        self.keep(word, hit)
        return hit


@dataclass
class Model:
    """A lexicon with the terms' weights, and the logistic model of the features."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    allowed: list[int] = field(default_factory=list)  # most edits of each term
    center: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(FEATURES))
    slopes: list[float] | None = None
    intercept: float = 0.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts in a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.matcher = Matcher(Trie(model.terms, model.allowed))

    def features(self, text: str) -> tuple[list[float], int, int, int]:
        """The features, and how many hits are exact, misspelled and quoted."""
        lower = text.lower()
        words = WORD.findall(lower)
        hits = set(filter(self.matcher.__getitem__, set(words)))
        if not hits:
            return [0.0] * len(FEATURES), 0, 0, 0
        spans = [m.span() for m in WORD.finditer(lower)]
        exact = misspelled = quoted = addressed = 0
        weight = 0.0
        for at, word in enumerate(words):
            if word not in hits:
                continue
            number, edits = self.matcher[word]
            near = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
            low, high = spans[at]
            first = spans[max(0, at - WINDOW)][0]
            last = spans[min(len(spans) - 1, at + WINDOW)][1]
            marked = any(c in OPENING for c in lower[first:low]) and any(c in CLOSING for c in lower[high:last])
            if marked or not REPORTING.isdisjoint(near):
                quoted += 1
                continue
            addressed += not ADDRESS.isdisjoint(near)
            misspelled += edits > 0
            exact += edits == 0
            weight = max(weight, self.model.weights[number] * EDIT_FACTOR**edits)
        values = [
            math.log1p(exact + misspelled),
            math.log1p(quoted),
            math.log1p(100 * (exact + misspelled) / len(words)),
            weight,
            math.log1p(addressed),
        ]
        return values, exact, misspelled, quoted

    def score(self, features: list[float]) -> float:
        model = self.model
        if model.slopes is None:
            return 0.0
        x = model.intercept + sum(
            s * (f - c) / d for s, f, c, d in zip(model.slopes, features, model.center, model.scale)
        )
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _terms(text: str) -> set[str]:
    """The distinct words of a text, and their stems with a star."""
    words = set(WORD.findall(text.lower()))
    stems = {word[:n] + "*" for word in words for n in STEMS if len(word) >= n}
    return {word for word in words if len(word) >= 4} | stems


def _lexicon(labelled: DataFrame, toxic_rows: int, clean_rows: int) -> tuple[list, list]:
    """Terms and weights from rows of text and toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in in_slices(batches):
            for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
                found[toxic].update(_terms(text))
            if len(found[0]) + len(found[1]) > 500_000:
                yield from sent(found)
                found = (Counter(), Counter())
        yield from sent(found)

    def sent(found: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        terms = [*found[1], *(t for t in found[0] if t not in found[1])]
        for low in range(0, len(terms), 50_000):
            part = terms[low : low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.string()),
                    pa.array([found[1].get(t, 0) for t in part], pa.int64()),
                    pa.array([found[0].get(t, 0) for t in part], pa.int64()),
                ],
                ["term", "toxic", "clean"],
            )

    share = toxic_rows / (toxic_rows + clean_rows)
    n = F.col("toxic") + F.col("clean")
    ratio = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (n * F.lit(share)))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * F.lit(1 - share)))).otherwise(0.0)
    )
    ranked = (
        labelled.mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") > 2 * F.lit(share) * n))
        .withColumn("ratio", ratio)
        .filter(F.col("ratio") >= LEAST_RATIO)
        # words before stems, longer before shorter ones where all else is equal
        .orderBy(F.desc("ratio"), F.col("term").endswith("*"), F.desc(F.length("term")), "term")
        .limit(20 * LEXICON_SIZE)
        .collect()
    )
    chosen: dict[str, float] = {}
    within: dict[str, int] = {}  # for each beginning of a chosen term its most toxic documents
    for row in ranked:
        term = row["term"]
        body = term.rstrip("*")
        if len(chosen) == LEXICON_SIZE:
            break
        if any(body[:k] + "*" in chosen for k in range(4, len(body) + 1)) or body in chosen:
            continue  # a chosen stem holds it
        if term.endswith("*") and row["toxic"] <= 1.05 * within.get(body, 0):
            continue  # it holds hardly more than a longer chosen term
        for k in range(4, len(body) + 1):
            within[body[:k]] = max(within.get(body[:k], 0), row["toxic"])
        chosen[term] = math.log((row["toxic"] + 0.5) / (toxic_rows + 1)) - math.log(
            (row["clean"] + 0.5) / (clean_rows + 1)
        )
    return [(t.rstrip("*"), t.endswith("*")) for t in chosen], list(chosen.values())


def _most_edits(term: str, stem: bool) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 or stem else 2


def _collisions(clean: DataFrame, model: Model) -> dict[int, int]:
    """In how many clean documents each term has misspellings: by term number, at most a count per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Trie(model.terms, model.allowed))
        found: Counter = Counter()
        for batch in in_slices(batches):
            for text in texts_of(batch.column("text")):
                hits = {matcher[w] for w in set(WORD.findall(text.lower()))}
                found.update({hit[0] for hit in hits if hit and hit[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"]
        )

    counted = clean.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def _logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and intercept of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([rows, np.ones(len(rows))])
    ridge = np.diag([0.5] * rows.shape[1] + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model:
    """A model from the documents that ``labels`` (doc_id, toxic) covers.

    At most about ``most_labels`` rows are used; rows with crc32(doc_id) mod 5 = 0 are left out.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    rows = known.count()
    share = min(1.0, most_labels / max(1, rows))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about most_labels rows of two numbers: bounded by the parameter
    labelled = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(picked), "doc_id")
        .select("text", "toxic", (F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(4)) == 0).alias("rest"))
    )
    counts = {(r["rest"], r["toxic"]): r["n"] for r in labelled.groupBy("rest", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get((False, 1), 0), counts.get((False, 0), 0)
    if not toxic or not clean:
        return Model()
    terms, weights = _lexicon(labelled.filter(~F.col("rest")).select("text", "toxic"), toxic, clean)
    model = Model(terms, weights, [_most_edits(*t) for t in terms])
    collisions = _collisions(labelled.filter(~F.col("rest") & (F.col("toxic") == 0)), model)
    model.allowed = [
        0 if collisions.get(i, 0) > MOST_COLLISIONS * clean else most for i, most in enumerate(model.allowed)
    ]
    fitted = labelled.filter("rest") if counts.get((True, 1), 0) >= 5 and counts.get((True, 0), 0) >= 5 else labelled

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in in_slices(batches):
            rows = [scorer.features(t)[0] for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"]
            )

    gathered = fitted.select("text", "toxic").mapInArrow(features, "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in gathered])
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    slopes, intercept = _logistic((x - center) / scale, np.array([r["toxic"] for r in gathered], dtype=float))
    model.center, model.scale = center.tolist(), scale.tolist()
    model.slopes, model.intercept = slopes.tolist(), intercept
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, exact, misspelled, quoted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in in_slices(batches):
            rows = [scorer.features(t) for t in texts_of(batch.column("text"))]
            scores = [scorer.score(r[0]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)),
                ],
                ["doc_id", "held_out", "score", "predicted", "exact", "misspelled", "quoted"],
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(
        run,
        "doc_id long, held_out boolean, score double, predicted int, exact long, misspelled long, quoted long",
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in in_slices(batches):
            texts = texts_of(batch.column(batch.schema.get_field_index("text")))
            clean = [scorer.score(scorer.features(t)[0]) < 0.5 for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
