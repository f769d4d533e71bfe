"""The secret scan against a scan that counts every window anew."""

import hashlib
import random
import re
from collections import Counter

import pytest

from keyweave.llm import secret_scan
from keyweave.llm.secret_scan import RULES, Rules

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# (pattern as the contract gives it, group whose length counts, least length)
PATTERNS = {"assign": (ASSIGN, 1, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}


def brute_force(text, rules=RULES):
    """(digest of the base spans, all spans)."""
    text, spans = text or "", []
    rest = list(text)
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            if len(m.group(group)) >= least:
                spans.append((m.start(), rank, m.end(), kind))
                rest[m.start() : m.end()] = " " * len(m.group())
    base, w = sorted(spans), rules.window
    weight, limit = secret_scan.weights(w), secret_scan.most_weight(rules)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % w, "".join(rest)):
        run = m.group()
        if run in rules.allowed or any(re.fullmatch(f, run) for f in rules.allowed_forms):
            continue
        found = []
        for at in range(len(run) - w + 1):
            window = run[at : at + w]
            digit, letter = re.search("[0-9]", window), re.search("[A-Za-z]", window)
            if re.search("[+/_=-]", window):
                kind = "base64"
            elif digit and letter:
                kind = "alnum" if re.search("[G-Zg-z]", window) else "hex"
            else:
                kind = "digits" if digit else "letters"
            if sum(weight[c] for c in Counter(window).values()) <= limit.get(kind, -1):
                start, end = m.start() + at, m.start() + at + w
                if found and start <= found[-1][2]:
                    found[-1] = (found[-1][0], 3, end, "entropy")
                else:
                    found.append((start, 3, end, "entropy"))
        spans += found
    listed = [",".join(f"{k}:{s}:{e}" for s, _, e, k in part) for part in (base, sorted(spans))]
    return hashlib.sha256(listed[0].encode()).hexdigest(), listed[1]


def check(spark, texts, rules=RULES):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs, rules).collect()}
    for i, text in enumerate(texts):
        digest, spans = brute_force(text, rules)
        assert (rows[i]["base_sha256"], rows[i]["spans"]) == (digest, spans), text
        kinds = Counter(s.split(":")[0] for s in spans.split(",") if s)
        assert {k: rows[i][f"n_{k}"] for k in secret_scan.KINDS} == {k: kinds[k] for k in secret_scan.KINDS}
    return rows


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def key(rng, length, symbols=64):
    return "".join(rng.choice(ALPHABET[:symbols]) for _ in range(length))


@pytest.mark.parametrize("rules", [RULES, Rules(window=8, least_bits={"hex": 2.5, "alnum": 2.9, "digits": 2.0}, allowed=(), allowed_forms=())])
def test_random_texts(spark, rules):
    rng = random.Random(5)
    pieces = ["token", "=", '"', "secret", ": ", "AKIA", "A1B2C3D4E5F6G7H8", "api_key", "PassWord", "abc", "deadbeef" * 3]
    pieces += ["Zx9+/", "q-W_e=", "\U0001f600", "é", " ", "\n", "hunter2", "'", ".", "foo/bar", "ſecret=abcdefgh", "toKen:abcdefgh"]
    texts = []
    for _ in range(400):
        count = rng.randint(0, 25)
        texts.append(
            "".join(rng.choice(pieces) if rng.random() < 0.8 else key(rng, rng.randint(10, 60), rng.choice((10, 36, 64))) for _ in range(count))
        )
    rows = check(spark, texts, rules)
    assert sum(r["n_entropy"] for r in rows.values()) > 100 and sum(r["n_assign"] for r in rows.values()) > 50


def test_failing_matches_use_up_their_text(spark):
    rows = check(spark, ["secret=token = abcdefgh", "token=ab", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "a" * 23, "a" * 24])
    assert [rows[i]["spans"] for i in range(6)] == ["", "", "", "access:0:20", "", "hex:0:24"]


def test_what_is_suspicious_and_what_is_allowed(spark):
    rng = random.Random(3)
    secret = "q8Zt3LkV0yXw6NcJ5rPb1GdHs7Ue"
    rows = check(
        spark,
        [
            f"x {secret} y",
            f"😀 {secret}",
            "images/holiday/beautiful-sunset-photograph-2021",
            "thoroughlyinterconnectednesses " * 5,
            "123e4567-e89b-12d3-a456-426614174000",
            "4111111111111111/4111111111111111",
            RULES.allowed[2],
            "Token='" + secret + "'",
            "http://host/" + key(rng, 40),
        ],
    )
    spans = {i: r["spans"] for i, r in rows.items()}
    assert spans[0] == "entropy:2:30" and spans[1] == "entropy:2:30" and spans[7] == "assign:0:35"
    assert [spans[i] for i in range(2, 7)] == [""] * 5 and rows[8]["n_entropy"] == 1


def test_findings_carry_strings_and_entropy(spark):
    secret = "q8Zt3LkV0yXw6NcJ5rPb1GdH"
    row = secret_scan.findings(spark.createDataFrame([(1, f"é {secret}.")], "doc_id long, text string")).head()
    (found,) = row["findings"]
    assert (found["string"], found["class"], found["kind"]) == (secret, "alnum", "entropy")
    assert found["bits"] == pytest.approx(4.585, abs=1e-3)  # all 24 differ


def test_long_texts_and_many_matches(spark):
    rng = random.Random(1)
    texts = ["token=abcdefg " * 3000, "a" * 200_000, key(rng, 4000), " ".join(key(rng, 30) for _ in range(300))]
    check(spark, texts)


def test_odd_rows(nasty, empty):
    rows = secret_scan.scan(nasty).collect()
    assert len(rows) == nasty.count() and secret_scan.scan(empty).collect() == []
    assert all(r["base_sha256"] and r["spans"] is not None for r in rows)


def test_no_python_in_the_plan(nasty):
    plan = secret_scan.scan(nasty)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
