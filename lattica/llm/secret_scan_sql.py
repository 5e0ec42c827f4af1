"""DuckDB SQL for the secret scan, written apart from its DataFrame form."""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAME = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either_case('api')}_?{_either_case('key')}"
ASSIGN = rf"""(?:{NAME})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, RUN = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{16,}"

#: Encoding, characters, alphabet in the order of its values (none: not tested).
ENCODINGS = (
    ("0-9", ""), ("0-9a-f", "0123456789abcdef"), ("0-9A-F", "0123456789ABCDEF"), ("a-z", ""), ("A-Z", ""), ("A-Z2-7", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("0-9a-z", "0123456789abcdefghijklmnopqrstuvwxyz"), ("A-Za-z0-9", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("A-Za-z0-9+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("A-Za-z0-9_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
CLASSES = (("digit", "0-9", 10), ("capital", "A-Z", 26), ("af", "a-f", 6), ("gz", "g-z", 20), ("sign", "+/_-", 4))


def _upper_tail(z: str) -> str:
    """Chance of a standard normal number above z (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + CAST(0.3275911 AS DOUBLE) * abs({z}) / sqrt(2)))"
    sum_ = "1.061405429"
    for c in ("-1.453152027", "1.421413741", "-0.284496736", "0.254829592"):
        sum_ = f"(CAST({c} AS DOUBLE) + {t} * {sum_})"
    half = f"(CAST(0.5 AS DOUBLE) * {t} * {sum_} * exp(-({z}) * ({z}) / 2))"
    return f"(CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END)"


def _spans(kind: int, pattern: str, where: str = "true", group: str = "''") -> str:
    """(r, kind, s, e, m) of all matches: sums of the lengths before."""
    return f"""SELECT r, {kind} AS kind, s, s + length(m) AS e, m FROM (
        SELECT r, m[k] AS m, {group} AS v, CAST(list_sum(list_transform(g[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0) AS BIGINT) AS s
        FROM (SELECT r, m, g, v, unnest(range(1, len(m) + 1)) AS k FROM (
            SELECT r, regexp_extract_all(x, '{pattern}', 0) AS m, string_split_regex(x, '{pattern}') AS g,
                   {f"regexp_extract_all(x, '{pattern}', 1)" if group != "''" else "[]"} AS v FROM d WHERE regexp_matches(x, '{pattern}')))) WHERE {where}"""


def secret_scan_sql(least_p: float = 0.01, alpha: float = 0.05, lengths: tuple[int, ...] = (16, 24, 32, 64), steps: int = 8, most_step: int = 4000) -> str:
    encoding = "CASE " + " ".join(f"WHEN regexp_full_match(body, '[{c}]+') THEN '{a}'" for c, a in ENCODINGS) + " ELSE '' END"
    length_class = "CASE " + " ".join(f"WHEN n >= {lo} THEN {k}" for k, lo in reversed([*enumerate(lengths)])) + " END"
    of_class = ", ".join(f"length(regexp_replace(body, '[^{c}]', '', 'g')) AS {k}" for k, c, _ in CLASSES)
    totals = ", ".join(f"sum(length(x) - length(regexp_replace(x, '[{c}]+', '', 'g'))) + 1.0 AS {k}" for k, c, _ in CLASSES)
    whole = " + ".join(k for k, _, _ in CLASSES)
    logs = ", ".join(f"ln(CAST({k} AS DOUBLE) / ({whole}) / {n}) AS {k}" for k, _, n in CLASSES)
    log_e = " + ".join(f"t.{k} * (-ln(CAST(size AS DOUBLE)) - logs.{k})" for k, _, _ in CLASSES)
    tail = lambda z: f"ln(greatest({z}, 1e-12))"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
        base AS MATERIALIZED ({_spans(0, ASSIGN, "length(v) >= 8", "v[k]")} UNION ALL {_spans(1, ACCESS)} UNION ALL {_spans(2, HEX)}),
        tested AS (SELECT r, s, e, rtrim(m, '=') AS body FROM ({_spans(3, f"{ASSIGN}|{RUN}")})
                   WHERE NOT regexp_matches(m, '{ASSIGN}|{ACCESS}|{HEX}')),
        named AS (SELECT *, length(body) AS n, {encoding} AS alphabet, {of_class} FROM tested WHERE length(body) >= 16),
        valued AS (SELECT *, length(alphabet) AS size, greatest(2, least(length(alphabet), n // 4)) AS bins,
                   list_transform(string_split(body, ''), lambda c: instr(alphabet, c) - 1) AS v FROM named WHERE alphabet <> ''),
        stats AS (SELECT *, list_sum(list_transform(range(0, bins), lambda b: power(len(list_filter(v, lambda z: z * bins // size = b)), 2) * size
                       / (CAST(n AS DOUBLE) * (ceil((b + 1) * size / CAST(bins AS DOUBLE)) - ceil(b * size / CAST(bins AS DOUBLE)))))) - n AS chi,
                   len(list_filter(range(1, n), lambda i: (v[i] * 2 >= size) <> (v[i + 1] * 2 >= size))) AS turns,
                   list_sum(list_transform(range(1, n), lambda i: (v[i] - (size - 1) / 2.0) * (v[i + 1] - (size - 1) / 2.0)))
                       / ((size * size - 1) / CAST(12 AS DOUBLE)) / (n - 1) AS serial FROM valued),
        normal AS (SELECT *, (power(chi / (bins - 1), 1 / CAST(3 AS DOUBLE)) - (1 - 2 / (CAST(9 AS DOUBLE) * (bins - 1)))) / sqrt(2 / (CAST(9 AS DOUBLE) * (bins - 1))) AS zc,
                   abs((turns - (n - 1) / CAST(2 AS DOUBLE)) / sqrt((n - 1) / CAST(4 AS DOUBLE))) AS zr, abs(serial * sqrt(CAST(n - 1 AS DOUBLE))) AS zs FROM stats),
        fisher AS (SELECT *, -({tail(_upper_tail("zc"))} + {tail("2 * " + _upper_tail("zr"))} + {tail("2 * " + _upper_tail("zs"))}) AS h FROM normal),
        logs AS (SELECT {logs} FROM (SELECT {totals} FROM d)),
        t AS MATERIALIZED (SELECT r, s, e, n, exp(-h) * (1 + h + h * h / 2) AS p, {length_class} AS class, {log_e} AS log_e FROM fisher t, logs),
        counts AS (SELECT class, greatest(-1, least({most_step}, floor(log_e * {steps}))) AS step, count(*) AS every, count(*) FILTER (p >= {least_p}) AS n FROM t GROUP BY ALL),
        sums AS (SELECT class, step, sum(n) OVER (PARTITION BY class ORDER BY step DESC) AS k, sum(every) OVER (PARTITION BY class) AS tests FROM counts),
        bars AS (SELECT class, min(step) / CAST({steps} AS DOUBLE) AS bar FROM sums
                 WHERE k > 0 AND step / CAST({steps} AS DOUBLE) >= ln(tests / (CAST({alpha} AS DOUBLE) * k)) GROUP BY class),
        spans AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, 3, s, e FROM t JOIN bars USING (class) WHERE p >= {least_p} AND log_e >= bar),
        listed AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS line FROM spans),
        texts AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
                  string_agg(line, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY s, kind, e) AS spans FROM listed GROUP BY r)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN texts USING (r)
    """
