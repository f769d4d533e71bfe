"""SQL that the queries of this package must agree with, where SQL can express them."""

from __future__ import annotations

from keyweave.llm import secret_scan


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secrets(rules: secret_scan.Rules = secret_scan.RULES) -> str:
    """The secret scan with every window counted anew, and spans by gaps and islands."""
    w = rules.window
    # case-insensitive for A-Z only
    word = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    patterns = {"assign": secret_scan.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", word)}
    patterns |= {"access": secret_scan.ACCESS, "hex": secret_scan.HEX}

    def cut(source: str, pattern: str) -> str:
        shape = _text(pattern)
        return f"""
            select rid, i, g, m, sum(length(g) + length(m)) over (partition by rid order by i) - length(m) as s
            from (select rid, generate_subscripts(string_split_regex(t, {shape}), 1) as i,
                         unnest(string_split_regex(t, {shape})) as g,
                         unnest(list_append(regexp_extract_all(t, {shape}), '')) as m
                  from {source})"""

    steps = ["d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents)"]
    base, source = [], "d"
    for rank, (kind, pattern) in enumerate(patterns.items()):
        _, group, least = secret_scan.BASE[kind]
        part = f"regexp_extract(m, {_text(pattern)}, {group})" if group else "m"
        good = f"(m <> '' and length({part}) >= {least})"
        steps.append(f"{kind}_all as materialized ({cut('d', pattern)})")
        base.append(f"select rid, s, {rank} as r, s + length(m) as e, '{kind}' as k from {kind}_all where {good}")
        steps.append(f"{kind}_again as ({cut(source, pattern)})")
        steps.append(
            f"{kind}_rest as materialized (select rid, string_agg(g || case when {good} then repeat(' ', length(m)) else m end,"
            f" '' order by i) as t from {kind}_again group by rid)"
        )
        source = f"{kind}_rest"
    run = f"[{secret_scan.SYMBOLS}-]{{{w},}}"
    forms = " or ".join(f"regexp_full_match(m, {_text(f)})" for f in rules.allowed_forms) or "false"
    allowed = ", ".join(map(_text, rules.allowed)) or "''"
    weights = ", ".join(f"({c}, {x})" for c, x in enumerate(secret_scan.weights(w)))
    limits = " ".join(f"when '{k}' then {v}" for k, v in secret_scan.most_weight(rules).items())
    steps += [
        f"candidates as ({cut(source, run)})",
        f"suspects as (select rid, s, m from candidates where m <> '' and not (m in ({allowed}) or {forms}))",
        f"""windows as (select rid, s as c, s + o as s, substr(m, o::bigint + 1, {w}) as v
            from (select rid, s, m, unnest(range(0, length(m) - {w} + 1)) as o from suspects))""",
        f"""loads as (select rid, c, s, v, sum(x) as load
            from (select rid, c, s, v, ch, count(*) as n
                  from (select rid, c, s, v, unnest(string_split(v, '')) as ch from windows) group by all)
            join (values {weights}) as t(n, x) using (n) group by all)""",
        f"""even as (select rid, c, s from (select *, case when regexp_matches(v, '[+/_=-]') then 'base64'
                when not regexp_matches(v, '[0-9]') then 'letters' when regexp_matches(v, '[G-Zg-z]') then 'alnum'
                when regexp_matches(v, '[A-Fa-f]') then 'hex' else 'digits' end as k from loads)
            where load <= case k {limits} else -1 end)""",
        f"""marked as (select *, sum(fresh) over (partition by rid, c order by s) as island
            from (select *, case when s <= lag(s) over (partition by rid, c order by s) + {w} then 0 else 1 end as fresh from even))""",
        " union all ".join(
            [
                "spans as materialized (" + base[0],
                *base[1:],
                f"select rid, min(s), {len(patterns)}, max(s) + {w}, 'entropy' from marked group by rid, c, island)",
            ]
        ),
    ]
    one = "k || ':' || s::bigint || ':' || e::bigint"
    counts = ", ".join(f"count(*) filter (k = '{k}') as n_{k}" for k in secret_scan.KINDS)
    return f"""
        with {", ".join(steps)}
        select doc_id, {counts},
               sha256(coalesce(string_agg({one}, ',' order by s, r, e) filter (r < {len(patterns)}), '')) as base_sha256,
               coalesce(string_agg({one}, ',' order by s, r, e), '') as spans
        from d left join spans using (rid) group by rid, doc_id
    """


def clusters(count: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Rounds of assignment by measuring every vector against every centroid."""
    steps = [
        f"""kept as materialized (select row_number() over () as r, vec_id, embedding as x from embeddings
            where len(embedding) = {dimensions} and len(list_filter(embedding, lambda y: isfinite(y))) = {dimensions})""",
        f"""parts as materialized (select r, vec_id, i, floor({scale} * y::double)::bigint as v from
            (select r, vec_id, generate_subscripts(x, 1) as i, unnest(x) as y from kept))""",
        f"""seeds as (select r, row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 as k from kept
            where vec_id is not null qualify k < {count})""",
        "c0 as materialized (select k, i, v from seeds join parts using (r))",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} as materialized (select r, arg_min(k, (d, k)) as k, min(d) as d from
                (select r, k, sum((p.v - c.v) * (p.v - c.v)) as d from parts p join c{n} c using (i) group by r, k) group by r)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} as materialized (select k, i, coalesce(m.v, c.v) as v from c{n} c left join
                    (select k, i, floor(sum(v) / count(*))::bigint as v from parts join a{n} using (r) group by k, i) m using (k, i))"""
            )
    return f"""
        with {", ".join(steps)},
        digests as (select k, sha256(string_agg(v::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by k)
        select vec_id, k::int as cluster, d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia,
               (sum(d) over ())::bigint as inertia, centroid_sha256
        from a{rounds} join kept using (r) join digests using (k)
    """


def resampling(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """Counts, gains, scores and ranks with each distinct word's CRC folded byte by byte."""
    import string

    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    words = f"unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    bit = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
        with recursive
        bits(b, c, n) as (select b, b::bigint, 0 from range(256) t(b) union all select b, {bit}, n + 1 from bits where n < 8),
        step as materialized (select b, c from bits where n = 8),
        d as materialized (select row_number() over () as r, doc_id, text from documents),
        own as materialized (select r, {words} as w from d),
        aim as materialized (select {words} as w from benchmark),
        vocabulary as materialized (select w, hex(encode(w)) as h from (select w from own union select w from aim)),
        folds(w, h, pos, c) as (
            select w, h, 1, 4294967295 from vocabulary
            union all
            select w, h, pos + 2, xor(folds.c >> 8, step.c) from folds
            join step on step.b = xor(folds.c, ('0x' || substr(h, pos, 2))::bigint) & 255
            where pos < length(h)),
        hashed as materialized (select w, xor(c, 4294967295) % {buckets} as bucket from folds where pos > length(h)),
        raw as (select bucket, count(*) as s from own join hashed using (w) group by bucket),
        wanted as (select bucket, count(*) as t from aim join hashed using (w) group by bucket),
        gains as materialized (
            select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from own) + {buckets})::double
                / ((s + 1)::double * ((select count(*) from aim) + {buckets})::double)))::bigint as gain
            from raw left join wanted using (bucket)),
        weights as (select r, count(*) as n, sum(gain)::bigint as weight from own join hashed using (w) join gains using (bucket) group by r),
        scored as materialized (
            select r, doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296))))::bigint as score
            from d left join weights using (r)),
        placed as (select r, row_number() over (order by score desc, doc_id nulls last) as rank from scored where n_features >= {least_words})
        select doc_id, n_features, weight, score,
               case when rank <= (select count(*) from placed) * {percent} // 100 then rank end as rank
        from scored left join placed using (r)
    """
