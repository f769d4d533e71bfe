"""Exact and near copies, repeated passages and fingerprints against brute force."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from keyweave.llm import exact_dedup, fingerprints, line_dedup, minhash
from keyweave.llm.components import components


def test_golomb_codes_give_the_values_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for most in (n + 1, 1 << 20, (1 << 63) + 5):
            values = np.unique(rng.integers(0, most, n, dtype=np.uint64))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)) == values).all()


@pytest.mark.parametrize("owners", [1, 5])
def test_suspects_are_the_documents_with_copies(documents, owners):
    rows = documents.select("doc_id", "text")
    texts = Counter(r["text"] for r in rows.collect())
    expected = {r["doc_id"] for r in rows.collect() if texts[r["text"]] > 1}
    found = {r["suspect_id"] for r in exact_dedup.suspects(rows, owners).collect()}
    assert found == expected and expected


def brute_groups(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    out = Counter()
    for doc_id, text in rows:
        keep = max((i for i in groups[text] if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out[(doc_id, keep, len(groups[text]), doc_id == keep, digest)] += 1
    return out


def test_groups_of_equal_texts(documents, nasty, empty):
    for docs in (documents, nasty, empty):
        assert Counter(map(tuple, exact_dedup.groups(docs).collect())) == brute_groups(docs)


def test_deduplicate_keeps_one_whole_row(documents, nasty, empty):
    for docs in (documents, nasty, empty):
        found = exact_dedup.deduplicate(docs)
        assert found.columns == docs.columns
        rows = found.collect()
        assert sorted(r["text"] or "" for r in rows) == sorted({r["text"] or "" for r in docs.collect()})
        given = set(map(tuple, docs.collect()))
        assert all(tuple(r) in given for r in rows)


def brute_classes(docs):
    """Classes of near duplicates by all pairs of word-shingle multisets."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = []
    for doc_id, text in rows:
        if doc_id is None:
            continue
        words = minhash.WORD.findall(text.lower())
        bag = Counter(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else Counter([tuple(words)] if words else [])
        known.append((doc_id, text, words, bag))
    for a in range(len(known)):
        for b in range(a):
            x, y = known[a], known[b]
            if x[2] or y[2]:
                common = (x[3] & y[3]).total()
                near = x[2] == y[2] or common >= 0.8 * ((x[3] | y[3]).total() or 1)
            else:
                near = x[1] == y[1]
            if near:
                i, j = sorted((root(x[0]), root(y[0])))
                parent[j] = i
    label = {i: root(i) for i in ids}
    sizes = Counter(label.values())
    return Counter(
        (i, label[i], sizes[label[i]], label[i] == i) if i is not None else (None, None, 1, True) for i, _ in rows
    )


def edited_copies(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 200]))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text = text * 3
            rows.append((number, " ".join(text)))
            number += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicate_classes(spark, documents, nasty, empty):
    for docs in (documents, edited_copies(spark), nasty, empty):
        assert Counter(map(tuple, minhash.classes(docs).collect())) == brute_classes(docs)


def test_near_deduplicate_keeps_one_of_each_class(nasty):
    rows = minhash.deduplicate(nasty).collect()
    kept = Counter(r["doc_id"] for r in rows)
    assert kept[1] == 1 and kept[4] == 0 and kept[7] == 2 and kept[None] == 2


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    errors = []
    for trial in range(80):
        a = [rng.choice(words) for _ in range(rng.choice([6, 40, 300]))]
        b = [w if rng.random() > rng.choice([0.01, 0.1]) else "x" for w in a] * (1 + trial % 3)
        owner, hashed, _ = minhash.shingles([" ".join(a), " ".join(b)], minhash.WordHash())
        signed = minhash.signatures(owner, hashed, 2)
        truth = minhash.overlap(hashed[owner == 0], hashed[owner == 1])
        errors.append((signed[0] == signed[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    found = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def brute_strip(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    keepers = defaultdict(list)
    for doc_id, text in rows:
        if doc_id is not None:
            for _, _, chunk, digest in line_dedup.marked(text):
                if digest is not None:
                    keepers[chunk.strip()].append(doc_id)
    out = Counter()
    for doc_id, text in rows:
        kept, seen = [], set()
        for _, _, chunk, digest in line_dedup.marked(text):
            body = chunk.strip()
            repeats = doc_id is not None and digest is not None and len(keepers[body]) > 1
            if not repeats or (min(keepers[body]) == doc_id and body not in seen):
                kept.append(chunk)
            seen.add(body)
        out[(doc_id, hashlib.sha256("".join(kept).encode()).hexdigest())] += 1
    return out


def test_repeated_passages_go(documents, nasty, empty):
    for docs in (documents, nasty, empty):
        found = line_dedup.report(docs)
        assert Counter((r["doc_id"], r["kept_sha256"]) for r in found.collect()) == brute_strip(docs)
        texts = line_dedup.strip(docs)
        assert texts.columns == docs.columns
        digests = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in texts.collect())
        assert digests == brute_strip(docs)


def test_chunks_join_to_the_text_and_survive_shifts(documents):
    for row in documents.collect():
        assert "".join(c for _, c in line_dedup.chunks(row["text"])) == row["text"]
    rng = random.Random(2)
    passage = " ".join(f"Sentence {rng.random()} is unlike any other one." for _ in range(30))
    first = {c.strip() for _, c in line_dedup.chunks("A start. " + passage)}
    second = {c.strip() for _, c in line_dedup.chunks("Another start. With more. And more! " + passage)}
    assert len(first & second) >= 0.7 * len(first)


def test_compare_walks_documents_in_descending_order(spark, documents, empty):
    rows = sorted(documents.collect(), key=lambda r: -r["doc_id"])
    for ranges in (1, 7):
        found = {r["doc_id"]: r for r in fingerprints.compare(documents, ranges).collect()}
        assert len(found) == len(rows)
        for row, after in zip(rows, rows[1:] + rows[:1]):
            half = len(row["text"]) // 2
            edited = row["text"][: len(row["text"]) - half] + after["text"][:half]
            got = found[row["doc_id"]]
            assert got["n_chars"] == len(row["text"])
            assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            own, changed, following = fingerprints.sketches([row["text"], edited, after["text"]])
            assert got["fingerprint"] == fingerprints.text_form(own)
            assert got["edited_fingerprint"] == fingerprints.text_form(changed)
            assert got["near_edited"] == fingerprints.likeness(own[None], changed[None])[0]
            assert got["near_next"] == fingerprints.likeness(own[None], following[None])[0]
    assert fingerprints.compare(empty).count() == 0


def test_compare_odd_rows(spark, nasty):
    found = fingerprints.compare(nasty, 3).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r["doc_id"] for r in nasty.collect())
    alone = fingerprints.compare(nasty.filter("doc_id = 1"), 4).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_fingerprints_do_not_depend_on_the_batch(documents):
    texts = [r["text"] for r in documents.collect()][:60]
    together = fingerprints.sketches(texts)
    for text, sketch in zip(texts, together):
        assert (fingerprints.sketches([text])[0] == sketch).all()


def test_fingerprints_survive_shifts():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    a, b, c = fingerprints.sketches([text, "some words in front " + text, text[::-1]])
    assert fingerprints.likeness(a[None], b[None])[0] > 0.85
    assert fingerprints.likeness(a[None], c[None])[0] < 0.1


def windows(text, size=50):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_planted_passages_of_fifty_to_eighty_words_go_whole(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passages, texts = [], []
    for n in range(300):
        # every other passage is a single sentence or line
        mark = "" if n % 2 else "."
        passages.append(" ".join(word() + mark * (k % 12 == 11) for k in range(rng.randint(50, 80))))
        for _ in range(2):
            before, after = (" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(2))
            texts.append((before, f"{before} {passages[n]} {after}".strip(), after))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[i], t[1]) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in line_dedup.strip(docs, extend=True).collect()}
    known, repeated, gone, whole = set(), 0, 0, 0
    for i in sorted(range(len(texts)), key=order.__getitem__):
        before, text, after = texts[i]
        found = windows(text) & known  # brute force, without the chunker
        known |= windows(text)
        kept = left[order[i]]
        if found:
            repeated += 1
            gone += not found & windows(kept)
            whole += kept.split() == f"{before} {after}".split()
        else:
            assert kept == text
    assert repeated == 300 and gone >= 0.98 * repeated and whole == gone


def test_extension_spares_what_others_rely_on(spark):
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(400)]
    text = " ".join(words)
    rows = [(1, text), (2, text.replace(words[200], "edited")), (3, text.replace(words[200], "edited")), (None, text)]
    left = {
        r["doc_id"]: r["text"].split()
        for r in line_dedup.strip(spark.createDataFrame(rows, "doc_id long, text string"), extend=True).collect()
    }
    assert left[1] == words and left[3] == [] and left[None] == words
    assert "edited" in left[2] and len(left[2]) < 40


def test_a_row_without_an_id_is_a_copy_of_one_with_an_id(spark):
    rows = [(5, "same text"), (None, "same text"), (None, "alone"), (6, "other"), (0, "zero"), (None, "twice"), (None, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for given in (docs, docs.repartition(7), docs.coalesce(1)):
        assert Counter(map(tuple, exact_dedup.groups(given).collect())) == brute_groups(docs)
        kept = {(r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(given).collect()}
        assert kept == {(5, "same text"), (None, "alone"), (6, "other"), (0, "zero"), (None, "twice")}


def test_places_of_chunks_that_do_not_repeat_are_not_stored(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(400)) + (" " + shared if i < 2 else "")) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = sum(1 for _, text in rows for *_, digest in line_dedup.marked(text) if digest)
    places, verified = line_dedup._verified(docs)
    assert 0 < verified.count() <= places.count() < chunks / 4


def test_unit_hashes_do_not_depend_on_blocks():
    rng = random.Random(22)
    texts = ["".join(rng.choices("ab c\n\té漢字", k=rng.randint(1, 400))) for _ in range(200)]
    texts += ["x" * 70_000 + " a b " + "y" * 200_000, "k" * 65_536, "k" * 65_537 + " q", " " * 70_000 + "z"]
    powers = [pow(int(line_dedup.ROLL), n + 1, 1 << 64) for n in range(1 << 16)]

    def plain(unit):
        worth = line_dedup.WORTH.tolist()
        return sum(worth[b] * powers[n & 0xFFFF] for n, b in enumerate(unit)) % (1 << 64)

    joined = b"".join(t.encode() for t in texts)
    units = line_dedup._units(joined)
    at = np.cumsum([0, *map(len, units[:-1])])
    expected = line_dedup._mixed(np.array([plain(u) for u in units], np.uint64))
    assert (line_dedup._unit_hashes(np.frombuffer(joined, np.uint8), at) == expected).all()


def odd_texts(seed):
    rng = random.Random(seed)
    parts = ["word", "of", "thing", " ", "  ", "\n", " ", "\t", ".", "! ", ".\n", "\xa0", "　", "漢字", "かな", "é", "\x1c", "\x85", " ", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.choice([2, 50, 600]))) for _ in range(400)]
    return texts + [None, "", " " * 500 + "a", "x" * 70_000 + " b", " " * 300, "漢" * 3000, "words " * 900 + " " * 100 + "q " * 30]


def test_chunks_cut_together_are_those_of_each_text():
    texts = odd_texts(31)
    texts += [f"　{t}\xa0" for t in texts[:40]]
    cut = line_dedup.Cut.of(pa.array(["left out", *texts], pa.string()).slice(1))
    low, high = cut.bodies
    hashes = defaultdict(set)
    for n, text in enumerate(texts):
        expected = list(line_dedup.marked(text or ""))
        places = range(cut.firsts[n], cut.firsts[n + 1])
        assert [cut.data[cut.starts[p] : cut.starts[p + 1]].decode() for p in places] == [c for _, _, c, _ in expected]
        for p, (_, _, chunk, digest) in zip(places, expected):
            assert cut.looked_for[p] == (digest is not None) == (len(chunk.strip().encode()) >= line_dedup.LEAST_BYTES)
            if digest is not None:
                assert cut.data[low[p] : high[p]].decode() == chunk.strip()
                hashes[chunk.strip()].add(int(cut.hashes[p]))
    assert {len(found) for found in hashes.values()} == {1}
    assert len({next(iter(found)) for found in hashes.values()}) > 0.99 * len(hashes)


def python_calls(run):
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        out = run()
    finally:
        sys.setprofile(None)
    return out, len(calls)


def test_steps_make_no_call_for_each_chunk():
    rng = random.Random(32)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(9000)) for _ in range(4)]
    chunks = sum(len(line_dedup.chunks(t)) for t in texts)
    ids = pa.array(range(4), pa.int64())
    docs = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["doc_id", "text"])
    out, calls = python_calls(lambda: list(line_dedup._hashes([docs])))
    assert sum(b.num_rows for b in out) > 0.9 * chunks and calls < chunks / 4
    kind = pa.list_(pa.struct([("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("own", pa.bool_())]))
    marks = [[{"place": 3 * p, "h1": p, "h2": n, "own": p % 2 == 0} for p in range(900)] for n in range(4)]
    batch = pa.RecordBatch.from_arrays([ids, pa.array(marks, kind)], ["marked_id", "marks"])
    out, calls = python_calls(lambda: list(line_dedup._edges([batch])))
    assert sum(b.num_rows for b in out) == 4 * 450 * 2 and calls < 900


def test_edges_stand_beside_places_that_do_not_repeat():
    rng = random.Random(33)
    kind = pa.list_(pa.struct([("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("own", pa.bool_())]))
    lists = [
        [{"place": p, "h1": rng.randint(0, 2), "h2": 5, "own": rng.random() < 0.5} for p in rng.sample(range(9), rng.randint(0, 7))]
        for _ in range(500)
    ]
    expected = set()
    for n, marks in enumerate(lists):
        known, seen = {m["place"] for m in marks}, set()
        for m in sorted(marks, key=lambda m: m["place"]):
            if not m["own"] or m["h1"] in seen:
                for after, beside in ((False, m["place"] - 1), (True, m["place"] + 1)):
                    if beside >= 0 and beside not in known:
                        expected.add((n, m["place"], after, m["h1"], 5))
            seen.add(m["h1"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(lists, kind)], ["marked_id", "marks"])
    [out] = line_dedup._edges([batch])
    assert sorted(tuple(r.values()) for r in out.to_pylist()) == sorted(expected)


def test_common_units_and_lines_are_those_of_plain_lists():
    rng = random.Random(34)
    plain = re.compile(r"[^\n.!?]+[.!?]*[^\S\n]*\n?|[.!?]+[^\S\n]*\n?|\n")
    for _ in range(5000):
        text = "".join(rng.choices("a.!? \n\t\xa0", k=rng.randint(0, 9)))
        assert line_dedup._lines(text) == len(plain.findall(text))
    for _ in range(5000):
        kind = rng.choice(["ab  \n", "ab \né漢　"])
        one, two = ("".join(rng.choices(kind, k=rng.randint(1, 12))) for _ in range(2))
        one, two = (one[:5] + two).encode(), (one + two[-5:]).encode()
        for found, order in ((line_dedup._common_after, list), (line_dedup._common_before, lambda x: x[::-1])):
            size = 0
            for own, theirs in zip(order(line_dedup._units(one)), order(line_dedup._units(two))):
                last = own != theirs
                if own.rstrip() != theirs.rstrip() or (last and size and found is line_dedup._common_before):
                    break
                size += len(own)
                if last and found is line_dedup._common_after:
                    break
            assert found(one, two) == size
