"""Secret scan by sliding-window Shannon entropy, in DataFrame functions only.

Base kinds are found by their patterns, leftmost and without overlaps. Their places are then blanked
out, and what remains is cut into candidate strings: maximal runs of key characters at least one
window long. A window slides over each candidate. One fold per candidate keeps the counts of the
window's characters in a fixed-size table, and changes them by the entering and the leaving
character only; the sum of ``count * log2(count)`` follows from the counts before and after in
whole millionths, so it doesn't depend on the order of additions. Counts per character class are
kept in the same way: the narrowest class that holds the whole window decides what entropy makes
it suspicious. Suspicious windows that touch or overlap become one span of kind ``entropy``.

Candidates on the allow-list are left out: whole strings known as examples, identifiers of fixed
form, and words or numbers joined by separators (paths, names, dates). It never removes a base span.

Everything is an expression of one row: no shuffle, no state beyond a row, and a lost executor
repeats its own rows. Texts are handled whole, in time linear in their length, at any length.

Definitions: a null or empty text has no spans; a null doc_id is kept; repeated rows give repeated
results; spans that start together are listed in the order of ``KINDS`` and then by their end; an
empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, and the least length of the group that must be long.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
# A run is found whole, so its least length can stand in the pattern.
HEX = r"[0-9a-f]{24,}"
BASE = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
KINDS = (*BASE, "entropy")

# Characters of candidate strings; each is one symbol of a window's counts.
SYMBOLS = "A-Za-z0-9+/_="
# What the narrowest class of a window is called, in order of width.
CLASSES = ("digits", "letters", "hex", "alnum", "base64")


@dataclass(frozen=True)
class Rules:
    """What counts as suspicious, and what never does.

    ``window``: characters of a window (at most 64). ``least_bits``: least entropy of a window of each
    class, in bits a character; a class that isn't named is never suspicious. ``allowed``: whole
    candidates that are known to be harmless. ``allowed_forms``: patterns that clear a candidate
    which they match from end to end.
    """

    window: int = 24
    least_bits: dict[str, float] = field(
        default_factory=lambda: {"letters": 4.3, "hex": 3.0, "alnum": 3.9, "base64": 4.0}
    )
    allowed: tuple[str, ...] = (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "0123456789ABCDEF0123456789ABCDEF",
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
    )
    allowed_forms: tuple[str, ...] = (
        # words or numbers joined by separators; a word may end in a number
        "[+/_=-]*([A-Za-z]+[0-9]{0,4}|[0-9]+)([+/_=-]+([A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/_=-]*",
        # identifiers of 8-4-4-4-12 hexadecimal digits
        "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    )


RULES = Rules()


def weights(window: int) -> list[int]:
    """count * log2(count) in millionths, for counts from 0 to the window's length."""
    return [0, *(round(1e6 * c * math.log2(c)) for c in range(1, window + 1))]


def most_weight(rules: Rules) -> dict[str, int]:
    """The largest sum of weights at which a window of a class is suspicious.

    The entropy of a window of W characters is log2(W) less that sum over W.
    """
    w = rules.window
    return {name: math.floor(1e6 * w * (math.log2(w) - bits)) for name, bits in rules.least_bits.items()}


def running(values: str, block: int = 256) -> str:
    """SQL for the sums of an integer array before each element.

    Folding into one growing array would copy it for each element; blocks of fixed size keep
    the copies per element within the block, and are joined with their offsets at the end.
    """
    inner = (
        "aggregate(slice({v}, b * {n} + 1, {n}), struct(cast(array() as array<int>) as sums, 0 as total),"
        " (s, x) -> struct(s.sums || array(s.total) as sums, s.total + x as total))"
    ).format(v=values, n=block)
    return (
        "flatten(aggregate("
        f"transform(sequence(0, (size({values}) - 1) div {block}), b -> {inner}),"
        " struct(cast(array() as array<array<int>>) as parts, 0 as total),"
        " (s, p) -> struct(s.parts || array(transform(p.sums, x -> x + s.total)) as parts, s.total + p.total as total),"
        " s -> s.parts))"
    )


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_places(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add ``name``: (string, start, end) of each match of a pattern, and ``name_gaps``: what lies between.

    Cutting the text at the matches and listing the matches see the same matches; their
    lengths in turn give the places, in code points.
    """
    shape = _literal(pattern)
    df = df.withColumn("_found", F.expr(f"regexp_extract_all({text}, {shape}, 0)"))
    df = df.withColumn(f"{name}_gaps", F.expr(f"split({text}, {shape}, -1)"))
    steps = (
        f"if(size(_found) = 0, cast(array() as array<int>), transform(slice({name}_gaps, 1, size(_found)),"
        " (g, i) -> char_length(g) + if(i = 0, 0, char_length(_found[i - 1]))))"
    )
    df = df.withColumn("_steps", F.expr(steps))
    df = df.withColumn("_before", F.expr(f"if(size(_steps) = 0, cast(array() as array<int>), {running('_steps')})"))
    places = (
        "transform(_found, (m, i) -> struct(m as string, _before[i] + _steps[i] as start,"
        " _before[i] + _steps[i] + char_length(m) as end))"
    )
    return df.withColumn(name, F.expr(places)).drop("_found", "_steps", "_before")


def _good(kind: str) -> str:
    """Whether a match ``p`` of a base kind is long enough."""
    pattern, group, least = BASE[kind]
    part = f"regexp_extract(p.string, {_literal(pattern)}, {group})" if group else "p.string"
    return f"char_length({part}) >= {least}"


def _blanked(text: str, name: str, kind: str) -> str:
    """The text with the good matches of a kind replaced by as many spaces."""
    return (
        f"if(size({name}) = 0, {text}, array_join(transform({name}_gaps, (g, i) -> if(i < size({name}),"
        f" g || transform(array({name}[i]), p -> if({_good(kind)}, repeat(' ', p.end - p.start), p.string))[0], g)), ''))"
    )


def _spans(rules: Rules) -> str:
    """The suspicious spans of candidate ``p``, by one fold over its characters.

    ``counts`` is a string of 128 characters: the one at a symbol's code is the symbol's count in the
    window, as the character of that code point beyond ``base``.
    """
    w, base = rules.window, 32
    rise = [b - a for a, b in zip(weights(w)[:-1], weights(w)[1:])]
    gains = f"array({', '.join(map(str, rise))})"
    limits = most_weight(rules)
    # codes of the entering and leaving symbols; 127 stands for none
    steps = f"transform(codes, (c, j) -> struct(c as enter, if(j >= {w}, codes[j - {w}], 127) as leave, j + 1 as at))"

    def count(counts: str, code: str) -> str:
        return f"(ascii(substring({counts}, {code} + 1, 1)) - {base})"

    def let(name: str, value: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def within(code: str, low: str, high: str) -> str:
        return f"{code} between {ord(low)} and {ord(high)}"

    digit = within("{c}", "0", "9")
    low = f"({within('{c}', 'a', 'f')} or {within('{c}', 'A', 'F')})"
    high = f"({within('{c}', 'g', 'z')} or {within('{c}', 'G', 'Z')})"
    other = "{c} in (" + ", ".join(str(ord(c)) for c in "+/_=-") + ")"

    def moved(name: str, test: str) -> str:
        return f"s.{name} + int({test.format(c='x.enter')}) - int({test.format(c='x.leave')}) as {name}"

    # the window after the step, in whole numbers
    entered = let(
        "c",
        count("s.counts", "x.enter"),
        "struct(overlay(s.counts placing char(c + {b}) from x.enter + 1 for 1) as counts,"
        " s.load + {g}[c] as load)".format(b=base + 1, g="gains"),
    )
    left = let(
        "e",
        entered,
        "if(x.leave = 127, e, "
        + let(
            "c",
            count("e.counts", "x.leave"),
            "struct(overlay(e.counts placing char(c + {b}) from x.leave + 1 for 1) as counts,"
            " e.load - {g}[c - 1] as load)".format(b=base - 1, g="gains"),
        )
        + ")",
    )
    window = (
        f"struct(v.counts as counts, v.load as load, {moved('digits', digit)}, {moved('low', low)},"
        f" {moved('high', high)}, {moved('other', other)}, s.open as open, s.spans as spans)"
    )
    klass = (
        "if(n.other > 0, 'base64', if(n.digits > 0, if(n.high > 0, 'alnum', if(n.low > 0, 'hex', 'digits')), 'letters'))"
    )
    limit = "case k " + " ".join(f"when '{name}' then {most}" for name, most in limits.items()) + " else -1 end"
    span = "struct(p.start + i - {w} as start, p.start + i as end, n.load as load, k as class)".format(w=w)
    # a suspicious window opens a span, or prolongs the open one if they touch or overlap
    joined = (
        "struct(s.open.start as start, p.start + i as end, least(s.open.load, n.load) as load,"
        " if(n.load < s.open.load, k, s.open.class) as class)"
    )
    step = let(
        "v",
        left,
        let(
            "n",
            window,
            let(
                "k",
                klass,
                f"if(i < {w} or n.load > {limit}, n,"
                " struct(n.counts as counts, n.load as load, n.digits as digits, n.low as low, n.high as high, n.other as other,"
                f" if(s.open is not null and p.start + i - {w} <= s.open.end, {joined}, {span}) as open,"
                f" if(s.open is not null and p.start + i - {w} > s.open.end, s.spans || array(s.open), s.spans) as spans))",
            ),
        ),
    )
    shape = "struct<start:int,end:int,load:int,class:string>"
    start = (
        f"struct(repeat('{chr(base)}', 128) as counts, 0 as load, 0 as digits, 0 as low, 0 as high, 0 as other,"
        f" cast(null as {shape}) as open, cast(array() as array<{shape}>) as spans)"
    )
    fold = f"aggregate({steps}, {start}, (s, x) -> {let('i', 'x.at', step)}, s -> if(s.open is null, s.spans, s.spans || array(s.open)))"
    return let("gains", gains, let("codes", "transform(split(p.string, ''), c -> ascii(c))", fold))


def findings(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(doc_id, text, findings): each document's spans as (start, rank, end, kind, string, class, bits).

    Places are code points, ends exclusive; ``rank`` is the kind's place in ``KINDS``. Spans of kind
    ``entropy`` carry the class and the entropy of their most even window.
    """
    if not 2 <= rules.window <= 64:
        raise ValueError("window must be from 2 to 64")
    df = docs.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("_text"))
    rest = "_text"
    parts = []
    for rank, kind in enumerate(BASE):
        # a match that an earlier kind covers is reported all the same
        df = _with_places(df, "_text", BASE[kind][0], f"_{kind}")
        parts.append(
            f"transform(filter(_{kind}, p -> {_good(kind)}), p -> struct(p.start as start, {rank} as rank, p.end as end,"
            f" '{kind}' as kind, p.string as string, cast(null as string) as class, cast(null as double) as bits))"
        )
        if rest == "_text":
            df = df.withColumn("_rest", F.expr(_blanked("_text", f"_{kind}", kind)))
            rest = "_rest"
        else:
            # blank this kind where earlier ones left anything of it
            df = _with_places(df, rest, BASE[kind][0], "_again")
            df = df.withColumn("_rest", F.expr(_blanked(rest, "_again", kind))).drop("_again", "_again_gaps")
    df = _with_places(df, rest, f"[{SYMBOLS}-]{{{rules.window},}}", "_candidates")
    allowed = ", ".join(map(_literal, rules.allowed)) or "''"
    forms = " or ".join(f"p.string rlike {_literal(f'^({form})$')}" for form in rules.allowed_forms) or "false"
    suspects = f"filter(_candidates, p -> not (p.string in ({allowed}) or {forms}))"
    df = df.withColumn("_suspects", F.expr(suspects))
    df = df.withColumn("_even", F.expr(f"flatten(transform(_suspects, p -> {_spans(rules)}))"))
    w = rules.window
    parts.append(
        f"transform(_even, q -> struct(q.start as start, {len(BASE)} as rank, q.end as end, 'entropy' as kind,"
        f" substring(_text, q.start + 1, q.end - q.start) as string, q.class as class, {math.log2(w)!r}D - q.load / {1e6 * w!r}D as bits))"
    )
    return df.select("doc_id", "text", F.sort_array(F.concat(*map(F.expr, parts))).alias("findings"))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Per document: the number of spans of each kind, all spans, and the digest of the base ones."""
    df = findings(docs, rules)
    found = F.col("findings")
    counts = [F.expr(f"size(filter(findings, f -> f.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in KINDS]
    base = F.filter(found, lambda f: f["rank"] < len(BASE))
    return df.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(found).alias("spans"))
