"""Toxicity, quality and license scores."""

import re
from collections import Counter

import numpy as np
import pytest

from keyweave.llm import licenses, quality, toxicity


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_finds_terms_within_their_edits():
    terms = [("idiot", False), ("worthless", False), ("trash", False), ("lowei", True)]
    matcher = toxicity.Matcher(toxicity.Trie(terms, [1, 2, 0, 1]))
    words = ["idiot", "idiott", "idot", "odiot", "idiots", "idooot", "worthles", "worthlles", "wrthlss", "trash"]
    words += ["trsh", "loweisch", "lweisch", "loewisch", "x", "", "worthlessness"]
    for word in words:
        hits = []
        for number, (term, stem) in enumerate(terms):
            distances = [brute_edits(word[:n], term) for n in range(len(word) + 1)] if stem else [brute_edits(word, term)]
            if min(distances) <= matcher.trie.allowed[number]:
                hits.append((min(distances), number))
        assert matcher[word] == ((min(hits)[1], min(hits)[0]) if hits else ()), word


def toxic_rows(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = f"some words {i} about the weather and a river {i % 7} in the morning"
        if bad:
            text += " you idiot" if i % 8 else " you complete morons and losers"
        rows.append((i, text))
        marks.append((i, int(bad)))
    rows += [(1000, "you are an idiott my friend"), (1001, 'he said "idiot" is a word one should not quote')]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_is_learned_and_misspellings_are_caught(spark):
    docs, marks = toxic_rows(spark)
    found = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, marks)).collect()}
    assert all(found[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert found[1000]["misspelled"] == 1 and found[1000]["predicted"] == 1
    assert found[1001]["quoted"] == 1 and found[1001]["predicted"] == 0


def test_toxicity_of_odd_tables(spark, nasty, empty, labels):
    for marks in (labels, labels.limit(0)):
        model = toxicity.learn(nasty, marks)
        found = toxicity.score(nasty, model).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in nasty.collect())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
        assert toxicity.keep_clean(nasty, model).columns == nasty.columns
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.learn(docs, marks)).join(marks, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in scored]) > 0.9
    model = quality.learn(docs, marks)
    kept = quality.sample(docs, model).join(marks, "doc_id").collect()
    good = [r["kept"] for r in kept if r["quality"] == 1]
    bad = [r["kept"] for r in kept if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_gumbel_sample_is_the_top_k(spark, documents, known_labels):
    model = quality.learn(documents, known_labels)
    for fraction in (0.0, 0.3, 1.0):
        rows = quality.sample(documents, model, fraction).collect()
        keys = sorted((r["key"] for r in rows if r["kept"]), reverse=True)
        k = int(len(keys) * fraction + 0.5)
        expected = set(keys[:k])
        assert {r["key"] for r in rows if r["sampled"]} == expected
        whole = quality.resample(documents, model, fraction)
        assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in rows if r["sampled"])


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(0, 3, 500).tolist(), 1.25, 1.25, 1.25]
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 250, 503):
        least = quality._kth_largest(frame, k)
        expected = sorted(values, reverse=True)[k - 1]
        assert sum(v >= least for v in values) == sum(v >= expected for v in values)


def test_quality_of_odd_tables(nasty, empty, labels):
    for marks in (labels, labels.limit(0)):
        model = quality.learn(nasty, marks)
        assert quality.sample(nasty, model).count() == nasty.count()
        assert quality.resample(nasty, model).columns == nasty.columns
    assert quality.sample(empty, quality.learn(empty, labels)).count() == 0


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_license(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    places, found = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        wanted = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(wanted)] == wanted:
                places.append(i)
                found.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def test_license_bases_and_labels(spark, documents, nasty, empty):
    extra = spark.createDataFrame(
        [
            (1, "x. Licensed under the Apache License, Version 2.0 (the License); MIT License. cc by cc by"),
            (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "Released under the MIT License."),
            (4, "apache version 2 license mit"),
            (5, "ÀPACHE LICENSE apache license apache license"),
        ],
        "doc_id long, text string",
    )
    for docs in (documents, nasty, extra, empty):
        expected = Counter((r["doc_id"], *brute_license(r["text"] or "")) for r in docs.collect())
        assert Counter(tuple(r)[:6] for r in licenses.scan(docs).collect()) == expected
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(extra).collect()}
    assert "apache-2.0" in labels[1][0] and "gpl-3.0" in labels[2][0] and labels[4] == ("", 0.0)
    assert all(0 <= score <= 1 for _, score in labels.values())


def test_every_notice_of_a_text_is_found(spark):
    texts = {label: text for label, (text, _) in licenses.TEMPLATES.items()}
    rows = [({a, b}, f"{texts[a]}. {texts[b]}.") for a in texts for b in texts]
    rows.append((set(texts), "\n".join(texts.values())))
    vocabulary = " ".join(sorted({w for text in texts.values() for w in re.split(r"\W+", text)}, reverse=True))
    rows += [({label}, f"{vocabulary} {'filler ' * 5000}{text}") for label, text in texts.items()]
    docs = [(n, text) for n, (_, text) in enumerate(rows)]
    # the words of some licences are frequent, so those of others are rarer throughout
    common = [t for label, t in texts.items() if "gpl" in label or label.startswith("cc") or label == "apache-2.0"]
    docs += [(1000 + n, common[n % len(common)]) for n in range(400)]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    lost = {n: expected - set(found[n]["labels"].split(",")) for n, (expected, _) in enumerate(rows)}
    assert not {n: labels for n, labels in lost.items() if labels}
    assert all(found[n]["score"] == 1.0 for n in lost)
