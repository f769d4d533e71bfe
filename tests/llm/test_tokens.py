"""Encoding, counting and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from keyweave.llm import byte_bpe, common, packing, token_count

RANKS = P.path("byte_bpe_50k.tiktoken")
COUNTS = P.path("byte_bpe_50k.json")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_at_random(n, seed):
    rng = random.Random(seed)
    letters = list("ab1 2'\n\t\r\x1c\x85\xa0​ é漢!?.'st　") + ["'s", "'ll", "²", "😀", "é", "      "]
    letters += ["the", "ing", " there", "<|endoftext|>", "aaaaaaaa"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def expected_round_trip(reference, text):
    ids = reference.encode_ordinary(text)
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(text.encode()).hexdigest(),
    )


def test_segments_join_to_the_text():
    for text in texts_at_random(300, 1):
        assert "".join(common.segments(text)) == text


def test_round_trip_of_random_texts(reference):
    encoder = byte_bpe.encoder(RANKS, P.PATTERN)
    texts = texts_at_random(1500, 2)
    for text, found in zip(texts, encoder.documents(texts)):
        assert found == expected_round_trip(reference, text)


def test_long_words_contract_like_short_ones(reference):
    encoder = byte_bpe.encoder(RANKS, P.PATTERN)
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcdehtn") for _ in range(rng.randint(1, 300)))
        assert encoder.contract_long(word.encode()) == reference.encode_ordinary(word)


def test_round_trip_rows(spark, nasty, documents, reference):
    for docs in (nasty, documents):
        texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        expected = Counter()
        for (doc_id, text), n in texts.items():
            expected[(doc_id, *expected_round_trip(reference, text))] += n
        assert Counter(map(tuple, byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect())) == expected


def test_decode_gives_the_texts_back(nasty):
    ids = byte_bpe.encode(nasty, RANKS, P.PATTERN)
    decoded = Counter(map(tuple, byte_bpe.decode(ids, RANKS, P.PATTERN).collect()))
    assert decoded == Counter((r["doc_id"], r["text"] or "") for r in nasty.collect())


def test_counts_of_random_texts_and_small_chunks(monkeypatch):
    library = Tokenizer.from_file(COUNTS)
    counter = token_count.counter(COUNTS, P.PATTERN)
    for chunk in (7, 1 << 14):
        monkeypatch.setattr(token_count, "CHUNK", chunk)
        for text in texts_at_random(1500, chunk):
            assert counter.count_text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_count_rows(nasty, documents):
    library = Tokenizer.from_file(COUNTS)
    for docs in (nasty, documents):
        expected = Counter()
        for row in docs.collect():
            text = row["text"] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            expected[(row["doc_id"], len(text.encode()), n, n > 1024)] += 1
        assert Counter(map(tuple, token_count.count_tokens(docs, COUNTS, P.PATTERN).collect())) == expected


def check_packing(docs, capacity=2048):
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for row in docs.collect():
        ids = [*library.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        for number, low in enumerate(range(0, len(ids), capacity)):
            piece = ids[low : low + capacity]
            code = zlib.crc32(np.array(piece, dtype="<u4").tobytes())
            expected[(row["doc_id"], number, low, len(piece), code)] += 1
    found = packing.pack(docs, WORDS, capacity).collect()
    assert Counter(tuple(r)[:5] for r in found) == expected
    sequences = defaultdict(list)
    for row in found:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in found)
    return len(sequences), -(-total // capacity)


def test_packing_is_exact_and_tight(documents, nasty):
    used, least = check_packing(documents)
    assert used <= least * 1.02 + 1
    check_packing(nasty)
    check_packing(nasty, capacity=7)


def test_plans_place_every_rank_once():
    rng = random.Random(5)
    for n in (0, 1, 7, 400, 20_000):
        histogram = Counter(min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(n))
        runs, sequences = packing.plan(dict(histogram), 64)
        ranks, fill = defaultdict(list), defaultdict(int)
        for length, rank, count, first, _ in runs:
            ranks[length] += range(rank, rank + count)
            for i in range(count):
                fill[first + i] += length
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
        assert max(fill.values(), default=0) <= 64 and set(fill) == set(range(sequences))


def test_empty_tables(empty):
    assert byte_bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    assert token_count.count_tokens(empty, COUNTS, P.PATTERN).count() == 0
    assert packing.pack(empty, WORDS).count() == 0


def test_plain_parts_are_cut_as_the_tokenizer_cuts_them():
    letters = [chr(c) for c in range(0x2070) if packing.PLAIN.fullmatch(chr(c))]
    texts = [t.lower() for c in letters for t in (c, f"a{c}b", f"{c}{c}1", f"'{c}s", f"{c}'s")]
    rng = random.Random(11)
    usual = list("''''strevmlld019²½_-.,!é\n\x85\xa0")
    texts += ["".join(rng.choices(usual, k=rng.randint(0, 25))) for _ in range(3000)]
    for text in texts:
        assert packing.parts_of(text) == packing.PART.findall(text)


def test_parts_of_plain_words_are_encoded_many_at_a_time(monkeypatch):
    rng = random.Random(12)
    words = sorted({"".join(rng.choices("abcdeéñ'1.", k=9)) for _ in range(2000)})
    tokenizer = Tokenizer.from_file(WORDS)
    expected = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    handed = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    coder = packing.WordIds(WORDS)
    for name, value in list(vars(coder).items()):
        if isinstance(value, Tokenizer):
            monkeypatch.setattr(coder, name, Counting(value))
    found = [np.frombuffer(ids, "<u4").tolist() for ids in coder.documents(words)]
    assert found == expected
    assert len(handed) < len(words) / 10
