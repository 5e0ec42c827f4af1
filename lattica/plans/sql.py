"""SQL for the registered queries, written for DuckDB, apart from the engine's code."""

from __future__ import annotations


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


LETTERS = " ABCDEFGHIJKLMNOPQRSTUVWXYZ.,"

#: Common table expressions, each with those that it needs.
_CTE: dict[str, tuple[str, str]] = {
    "emb": ("", """SELECT s, i, CASE WHEN v < -0.05 THEN 0 WHEN v <= 0.05 THEN 1 ELSE 2 END AS a FROM (
        SELECT vec_id AS s, CAST(unnest(range(1, 65)) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""),
    "nbr": ("emb", """SELECT s, count(*) AS n FROM (SELECT x.s, y.s AS t FROM emb x JOIN emb y USING (i, a) GROUP BY ALL
        HAVING count(*) >= (1 - CAST(0.4 AS DOUBLE)) * 64) GROUP BY s"""),
    "w": ("nbr", "SELECT s, CAST(1.0 AS DOUBLE) / n AS w FROM nbr"),
    "ne": ("w", "SELECT sum(w) AS neff FROM w"),
    "sites": ("", "SELECT CAST(i AS INT) AS i, CAST(a AS INT) AS a FROM range(1, 65) r(i), range(0, 3) q(a)"),
    "cells": ("sites", "SELECT x.i, y.i AS j, x.a, y.a AS b FROM sites x JOIN sites y ON x.i < y.i"),
    "fi": ("emb w ne sites", """SELECT i, a, coalesce(n, 0.0) / (SELECT neff FROM ne) AS f FROM sites
        LEFT JOIN (SELECT i, a, sum(w) AS n FROM emb JOIN w USING (s) GROUP BY ALL) USING (i, a)"""),
    "pn": ("emb w", """SELECT x.i, y.i AS j, x.a, y.a AS b, sum(w) AS n FROM emb x JOIN emb y ON x.s = y.s AND x.i < y.i
        JOIN w ON w.s = x.s GROUP BY ALL"""),
    "fij": ("pn ne cells", """SELECT i, j, a, b, coalesce(n, 0.0) / (SELECT neff FROM ne) AS f FROM cells LEFT JOIN pn USING (i, j, a, b)"""),
    "e": ("fi fij", """SELECT p.i, p.j, p.a, p.b, p.f - x.f * y.f AS e FROM fij p JOIN fi x ON x.i = p.i AND x.a = p.a
        JOIN fi y ON y.i = p.j AND y.a = p.b"""),
    "h": ("fi ne", """SELECT i, a, l - avg(l) OVER (PARTITION BY i) AS h FROM (SELECT i, a, ln(f * (SELECT neff FROM ne) + 1) AS l FROM fi)"""),
    "es": ("e", "SELECT i, j, a, b, e FROM e UNION ALL SELECT j, i, b, a, e FROM e"),
    "en": ("emb h es w", """SELECT o.s, o.i, h.a, o.a AS seen, h.h + coalesce(sum(es.e), 0.0) AS energy
        FROM emb o JOIN h ON h.i = o.i JOIN emb t ON t.s = o.s AND t.i <> o.i
        JOIN es ON es.i = o.i AND es.a = h.a AND es.j = t.i AND es.b = t.a GROUP BY o.s, o.i, h.a, o.a, h.h"""),
    "p": ("en", """SELECT *, exp(energy - z) AS p FROM (SELECT *, m + ln(sum(exp(energy - m)) OVER (PARTITION BY s, i)) AS z FROM (
        SELECT *, max(energy) OVER (PARTITION BY s, i) AS m FROM en))"""),
    "p0": ("emb h", """SELECT o.s, o.i, h.a, o.a AS seen, h.h AS energy, exp(h.h) / sum(exp(h.h)) OVER (PARTITION BY o.s, o.i) AS p
        FROM emb o JOIN h ON h.i = o.i"""),
    "fn": ("e", "SELECT i, j, sqrt(sum(e * e)) AS fn FROM e GROUP BY i, j"),
    "sym": ("fn", "SELECT i, fn FROM fn UNION ALL SELECT j, fn FROM fn"),
    "mean": ("sym", "SELECT i, sum(fn) / 63 AS m FROM sym GROUP BY i"),
    "cn": ("fn mean", """SELECT fn.i, fn.j, fn.fn, fn.fn - x.m * y.m / (SELECT avg(fn) FROM fn) AS cn FROM fn
        JOIN mean x ON x.i = fn.i JOIN mean y ON y.i = fn.j"""),
    "v": ("e", "SELECT i, j, var_pop(e) AS v FROM e GROUP BY i, j"),
    "vm": ("v", "SELECT i, sum(v) / 63 AS m FROM (SELECT i, v FROM v UNION ALL SELECT j, v FROM v) GROUP BY i"),
    "pri": ("v vm", """SELECT i, j, v, x, CASE WHEN x > 0 THEN least(greatest(1 / (2 * x), 0.01), 10000.0) ELSE 10000.0 END AS lam FROM (
        SELECT v.i, v.j, v.v, v.v - x.m * y.m / (SELECT avg(v) FROM v) AS x FROM v JOIN vm x ON x.i = v.i JOIN vm y ON y.i = v.j)"""),
    "seq": ("", """SELECT {'doc_id': doc_id, 'piece': piece} AS s, doc_id || '/' || piece AS name, rpad(substring(text, piece * 24 + 1, 24), 24, ' ') AS seq
        FROM (SELECT doc_id, text, CAST(unnest(range(0, CAST(ceil(length(text) / 24.0) AS BIGINT))) AS INT) AS piece FROM documents)"""),
    "let": ("seq", f"""SELECT s, i, CASE WHEN instr('{LETTERS}', c) > 0 THEN instr('{LETTERS}', c) - 1
        WHEN c BETWEEN 'a' AND 'z' THEN instr('{LETTERS}', chr(ascii(c) - 32)) - 1 - 29 ELSE 29 END AS c
        FROM (SELECT s, CAST(unnest(range(1, 25)) AS INT) AS i, unnest(string_split(seq, '')) AS c FROM seq)"""),
    "bad": ("let", "SELECT DISTINCT s FROM let WHERE c = 29"),
    "ok": ("let bad", "SELECT s, i, CASE WHEN c < 0 THEN c + 29 ELSE c END AS a FROM let ANTI JOIN bad USING (s)"),
    # at most 4 of 24 letters differ, so one of 5 segments agrees; equal pieces are summed first
    "okw": ("seq", """SELECT s, translate(seq, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u FROM seq WHERE regexp_full_match(seq, '[A-Za-z ., ]*')"""),
    "okd": ("okw", "SELECT u, count(*) AS n FROM okw GROUP BY u"),
    "okg": ("okd", "SELECT u, n, k, substring(u, a, b) AS part FROM okd, (VALUES (0, 1, 4), (1, 5, 5), (2, 10, 5), (3, 15, 5), (4, 20, 5)) g(k, a, b)"),
    "okp": ("okg", """SELECT DISTINCT x.u AS u, y.u AS v, y.n FROM okg x JOIN okg y USING (k, part)
        WHERE 24 - hamming(x.u, y.u) >= (1 - CAST(0.2 AS DOUBLE)) * 24"""),
    "okn": ("okw okp", "SELECT s, CAST(t AS BIGINT) AS n FROM okw JOIN (SELECT u, sum(n) AS t FROM okp GROUP BY u) USING (u)"),
    "aim": ("seq", "SELECT s, name FROM seq WHERE name LIKE '1%' ORDER BY s LIMIT 1"),
    "target": ("aim let", """SELECT i, c FROM let WHERE s = (SELECT s FROM aim) AND c NOT IN (0, -29)"""),
    "li": ("", """SELECT row_number() OVER () AS s, [instr('ANR', l_returnflag) - 1, instr('FO', l_linestatus) - 1, l_linenumber - 1,
        CAST(round(l_discount * 100) AS INT), CAST(round(l_tax * 100) AS INT), CAST(quarter(l_shipdate) AS INT) - 1] AS c FROM lineitem"""),
    "lil": ("li", "SELECT s, CAST(unnest(range(1, 7)) AS INT) AS i, CAST(unnest(c) AS INT) AS a FROM li"),
    "lis": ("", "SELECT CAST(i AS INT) AS i, CAST(a AS INT) AS a FROM range(1, 7) r(i), range(0, 11) q(a)"),
    "gap": ("emb", "SELECT s, i, a - 1 AS a FROM emb WHERE a > 0"),
    "gsites": ("sites", "SELECT i, a FROM sites WHERE a < 2"),
    "gfi": ("gap w gsites", """SELECT i, a, CASE WHEN t > 0 THEN n / t ELSE 0.5 END AS f FROM (
        SELECT i, a, coalesce(n, 0.0) AS n, sum(coalesce(n, 0.0)) OVER (PARTITION BY i) AS t FROM gsites
        LEFT JOIN (SELECT i, a, sum(w) AS n FROM gap JOIN w USING (s) GROUP BY ALL) USING (i, a))"""),
    "gfij": ("gap w gsites", """SELECT i, j, a, b, CASE WHEN t > 0 THEN n / t ELSE 0.25 END AS f FROM (
        SELECT i, j, a, b, coalesce(n, 0.0) AS n, sum(coalesce(n, 0.0)) OVER (PARTITION BY i, j) AS t
        FROM (SELECT x.i, y.i AS j, x.a, y.a AS b FROM gsites x JOIN gsites y ON x.i < y.i)
        LEFT JOIN (SELECT x.i, y.i AS j, x.a, y.a AS b, sum(w) AS n FROM gap x JOIN gap y ON x.s = y.s AND x.i < y.i
                   JOIN w ON w.s = x.s GROUP BY ALL) USING (i, j, a, b))"""),
    "ge": ("gfi gfij", """SELECT p.i, p.j, p.a, p.b, p.f - x.f * y.f AS e FROM gfij p JOIN gfi x ON x.i = p.i AND x.a = p.a
        JOIN gfi y ON y.i = p.j AND y.a = p.b"""),
    "ges": ("ge", "SELECT i, j, a, b, e FROM ge UNION ALL SELECT j, i, b, a, e FROM ge"),
    "gh": ("gfi ne", "SELECT i, a, l - avg(l) OVER (PARTITION BY i) AS h FROM (SELECT i, a, ln(f * (SELECT neff FROM ne) + 1) AS l FROM gfi)"),
    "gen": ("gap gh ges", """SELECT o.s, o.i, gh.a, o.a AS seen, gh.h + coalesce(sum(ges.e), 0.0) AS energy
        FROM gap o JOIN gh ON gh.i = o.i LEFT JOIN gap t ON t.s = o.s AND t.i <> o.i
        LEFT JOIN ges ON ges.i = o.i AND ges.a = gh.a AND ges.j = t.i AND ges.b = t.a GROUP BY o.s, o.i, gh.a, o.a, gh.h"""),
    "gpr": ("gen", """SELECT *, exp(energy - z) AS p FROM (SELECT *, m + ln(sum(exp(energy - m)) OVER (PARTITION BY s, i)) AS z FROM (
        SELECT *, max(energy) OVER (PARTITION BY s, i) AS m FROM gen))"""),
    "ctr": ("emb", "SELECT dense_rank() OVER (ORDER BY s) - 1 AS cluster, i, a FROM emb WHERE s IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8)"),
    "asg": ("emb ctr", """SELECT s, arg_max(cluster, (m, -cluster)) AS cluster FROM (
        SELECT s, cluster, sum(CAST(x.a = y.a AS INT)) AS m FROM emb x JOIN ctr y USING (i) GROUP BY s, cluster) GROUP BY s"""),
    "con": ("emb asg", """SELECT cluster, i, arg_max(a, (n, -a)) AS a, max(n) AS n FROM (
        SELECT cluster, i, a, count(*) AS n FROM emb JOIN asg USING (s) GROUP BY ALL) GROUP BY cluster, i"""),
    "near": ("con", """SELECT x.cluster AS c, y.cluster AS d FROM con x JOIN con y USING (i) GROUP BY ALL
        HAVING sum(CAST(x.a = y.a AS INT)) >= CAST(0.9 AS DOUBLE) * (1 - CAST(0.4 AS DOUBLE)) * 64"""),
}


def _sql(needs: str, body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for x in _CTE[name][0].split():
            add(x)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    ctes = ",\n".join(f'"{n}" AS MATERIALIZED ({_CTE[n][1]})' for n in order)
    return f"WITH {ctes}\n{body}" if order else body


_PENALTY = "(SELECT sum(0.01 * h * h) FROM h) + (SELECT sum(CAST(1.0 AS DOUBLE) * e * e) FROM e)"
_NLL = "(SELECT sum(w * (z - energy)) FROM p JOIN w USING (s) WHERE a = seen)"


def _field_gradient(p: str) -> str:
    return f"""SELECT i, a, {_r("g + 2 * CAST(0.01 AS DOUBLE) * h")} AS g FROM (
        SELECT i, a, sum(w * (p - CAST(a = seen AS INT))) AS g FROM {p} JOIN w USING (s) GROUP BY i, a) JOIN h USING (i, a)"""


def _coupling_gradient(p: str, plus: str) -> str:
    return f"""SELECT c.i, c.j, c.a, c.b, {_r(f"coalesce(g, 0.0) + {plus}")} AS g FROM cells c JOIN e USING (i, j, a, b) LEFT JOIN (
        SELECT i, j, a, b, sum(r) AS g FROM (
            SELECT least(q.i, t.i) AS i, greatest(q.i, t.i) AS j, CASE WHEN q.i < t.i THEN q.a ELSE t.a END AS a,
                   CASE WHEN q.i < t.i THEN t.a ELSE q.a END AS b, w * (p - CAST(q.a = seen AS INT)) AS r
            FROM {p} q JOIN w ON w.s = q.s JOIN emb t ON t.s = q.s AND t.i <> q.i) GROUP BY i, j, a, b) USING (i, j, a, b)"""


ORACLES: dict[str, str] = {
    "msa_encode": _sql("let", "SELECT s.doc_id AS doc_id, s.piece AS piece, string_agg(CAST(c AS VARCHAR), ',' ORDER BY i) AS codes FROM let GROUP BY s"),
    "msa_valid_rows": _sql("ok", "SELECT s.doc_id AS doc_id, s.piece AS piece, string_agg(CAST(a AS VARCHAR), ',' ORDER BY i) AS codes FROM ok GROUP BY s"),
    "msa_skipped_rows": _sql("bad", "SELECT s.doc_id AS doc_id, s.piece AS piece FROM bad"),
    "alignment_lengths": _sql("seq", "SELECT CAST(min(length(seq)) AS INT) AS least, CAST(max(length(seq)) AS INT) AS most, count(*) AS n FROM seq"),
    "focus_columns": _sql("target", "SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS i, i AS source_column FROM target"),
    "focus_offsets": _sql("target bad seq let aim", f"""SELECT CAST(row_number() OVER (ORDER BY t.i) AS INT) AS i,
        CAST(t.i - 1 + coalesce(TRY_CAST(regexp_extract((SELECT name FROM aim), '^1/([0-9]+)', 1) AS INT), 1) AS INT) AS "offset",
        coalesce('{LETTERS}'[CASE WHEN k.c < 0 THEN k.c + 29 ELSE k.c END + 1], '-') AS letter FROM target t LEFT JOIN let k ON k.i = t.i
        AND k.s = (SELECT seq.s FROM seq ANTI JOIN bad USING (s) WHERE seq.s <= (SELECT s FROM aim) ORDER BY seq.s DESC LIMIT 1)"""),
    "lineitem_codes": _sql("li", "SELECT array_to_string(c, ',') AS codes, count(*) AS n FROM li GROUP BY ALL"),
    "neighbor_counts": _sql("nbr", "SELECT s, n FROM nbr"),
    "neighbor_counts_segments": _sql("emb", """SELECT s, count(*) AS n FROM (SELECT x.s, y.s AS t FROM emb x JOIN emb y USING (i, a)
        GROUP BY ALL HAVING count(*) >= (1 - CAST(0.2 AS DOUBLE)) * 64) GROUP BY s"""),
    "neighbor_counts_documents": _sql("okn", "SELECT s.doc_id AS doc_id, s.piece AS piece, n FROM okn"),
    "seq_weights": _sql("nbr", f"SELECT s, {_r('CAST(2.0 AS DOUBLE) / n')} AS w FROM nbr"),
    "n_eff": _sql("ne", f"SELECT {_r('neff')} AS n_eff FROM ne"),
    "weights_realigned": _sql("seq okn", f"SELECT s.doc_id AS doc_id, s.piece AS piece, {_r('coalesce(CAST(1.0 AS DOUBLE) / n, 0.0)')} AS weight FROM seq LEFT JOIN okn USING (s)"),
    "weights_of_skipped": _sql("bad", "SELECT s.doc_id AS doc_id, s.piece AS piece, CAST(1.0 AS DOUBLE) AS weight FROM bad WHERE (s.doc_id + s.piece) % 2 = 0 ORDER BY s LIMIT 64"),
    "cluster_assign": _sql("asg", "SELECT s, CAST(cluster AS INT) AS cluster FROM asg"),
    "cluster_consensus": _sql("con", "SELECT CAST(cluster AS INT) AS cluster, i, a, n FROM con"),
    "cluster_sizes": _sql("asg", """SELECT CAST(cluster AS INT) AS cluster, n, CAST(sum(n) OVER (ORDER BY cluster) - n AS BIGINT) AS start,
        CAST(sum(n) OVER (ORDER BY cluster) AS BIGINT) AS "end" FROM (SELECT cluster, count(*) AS n FROM asg GROUP BY cluster)"""),
    "cluster_neighbors": _sql("emb asg near", """SELECT s, count(*) AS n FROM (
        SELECT x.s, y.s AS t FROM emb x JOIN emb y ON x.i = y.i AND x.a = y.a JOIN asg k ON k.s = x.s JOIN asg l ON l.s = y.s
        JOIN near ON near.c = k.cluster AND near.d = l.cluster GROUP BY ALL
        HAVING count(*) >= (1 - CAST(0.4 AS DOUBLE)) * 64) GROUP BY s"""),
    "site_marginals": _sql("fi", f"SELECT i, a, {_r('f')} AS f FROM fi"),
    "pair_marginals": _sql("fij", f"SELECT i, j, a, b, {_r('f')} AS f FROM fij"),
    "site_marginals_li": _sql("lil lis", f"""SELECT i, a, {_r('coalesce(n, 0.0) / (SELECT count(*) FROM lineitem)')} AS f FROM lis
        LEFT JOIN (SELECT i, a, CAST(count(*) AS DOUBLE) AS n FROM lil GROUP BY ALL) USING (i, a)"""),
    "pair_marginals_li": _sql("lil lis", f"""SELECT i, j, a, b, {_r('coalesce(n, 0.0) / (SELECT count(*) FROM lineitem)')} AS f FROM (
        SELECT x.i, y.i AS j, x.a, y.a AS b FROM lis x JOIN lis y ON x.i < y.i) LEFT JOIN (
        SELECT x.i, y.i AS j, x.a, y.a AS b, CAST(count(*) AS DOUBLE) AS n FROM lil x JOIN lil y ON x.s = y.s AND x.i < y.i GROUP BY ALL)
        USING (i, j, a, b)"""),
    "site_marginals_gap": _sql("gfi", f"SELECT i, a, {_r('f')} AS f FROM gfi"),
    "pair_marginals_gap": _sql("gfij", f"SELECT i, j, a, b, {_r('f')} AS f FROM gfij"),
    "init_fields": _sql("h", f"SELECT i, a, {_r('h')} AS h FROM h"),
    "column_information": _sql("fi", f"""SELECT i, {_r('x')} AS entropy, {_r('log2(3) - x')} AS information FROM (
        SELECT i, sum(CASE WHEN f > 0 THEN -f * log2(f) ELSE 0 END) AS x FROM fi GROUP BY i)"""),
    "pair_covariances": _sql("e", f"SELECT i, j, a, b, {_r('e')} AS e FROM e"),
    "nll_init": _sql("p0 w", f"""SELECT {_r('sum(-w * ln(p))', 4)} AS nll FROM p0 JOIN w USING (s) WHERE a = seen"""),
    "grad_fields_init": _sql("p0 w h", _field_gradient("p0")),
    "grad_couplings_init": _sql("p0 w e emb cells", _coupling_gradient("p0", "0.0")),
    "potentials": _sql("en", f"SELECT s, i, a, {_r('energy')} AS energy FROM en"),
    "site_conditionals": _sql("p", f"SELECT s, i, a, {_r('p')} AS p FROM p"),
    "objective_fixed_params": _sql("p w h e", f"SELECT {_r(_NLL, 4)} AS nll, {_r(_PENALTY, 4)} AS penalty, {_r(f'{_NLL} + {_PENALTY}', 4)} AS objective"),
    "grad_fixed_fields": _sql("p w h", _field_gradient("p")),
    "grad_fixed_couplings": _sql("p w e emb cells", _coupling_gradient("p", "2 * e")),
    "objective_gap": _sql("gen w", f"""SELECT {_r('sum(w * (z - energy))', 4)} AS nll FROM (
        SELECT *, ln(sum(exp(energy)) OVER (PARTITION BY s, i)) AS z FROM gen) JOIN w USING (s) WHERE a = seen"""),
    "grad_gap_fields": _sql("gpr w gh", f"""SELECT i, a, {_r("coalesce(g, 0.0) + 2 * CAST(0.01 AS DOUBLE) * h")} AS g FROM gh LEFT JOIN (
        SELECT i, a, sum(w * (p - CAST(a = seen AS INT))) AS g FROM gpr JOIN w USING (s) GROUP BY i, a) USING (i, a)"""),
    "grad_gap_couplings": _sql("gpr w ge gap", f"""SELECT ge.i, ge.j, ge.a, ge.b, {_r("coalesce(g, 0.0) + 2 * e")} AS g FROM ge LEFT JOIN (
        SELECT i, j, a, b, sum(r) AS g FROM (
            SELECT least(q.i, t.i) AS i, greatest(q.i, t.i) AS j, CASE WHEN q.i < t.i THEN q.a ELSE t.a END AS a,
                   CASE WHEN q.i < t.i THEN t.a ELSE q.a END AS b, w * (p - CAST(q.a = seen AS INT)) AS r
            FROM gpr q JOIN w ON w.s = q.s JOIN gap t ON t.s = q.s AND t.i <> q.i) GROUP BY i, j, a, b) USING (i, j, a, b)"""),
    "gradient_norms": _sql("p w h e emb cells", f"""SELECT {_r("(SELECT sqrt(sum(g * g)) FROM (" + "HG" + "))", 4)} AS h_gradient,
        {_r("(SELECT sqrt(sum(g * g)) FROM (" + "EG" + "))", 4)} AS e_gradient""").replace("HG", _field_gradient("p")).replace("EG", _coupling_gradient("p", "2 * e")),
    "group_penalty": _sql("e", f"""SELECT {_r('CAST(0.5 AS DOUBLE) * sum(x)')} AS penalty FROM (
        SELECT sqrt(0.001 + sum(e * e)) AS x FROM e GROUP BY i, j)"""),
    "parameter_norms": _sql("h e", f"""SELECT {_r('(SELECT sqrt(sum(h * h)) FROM h)')} AS h_norm, {_r('(SELECT sqrt(sum(e * e)) FROM e)')} AS e_norm,
        {_r('(SELECT max(abs(e)) FROM e)')} AS e_max"""),
    "coupling_norms": _sql("fn", f"SELECT i, j, {_r('fn')} AS fn FROM fn"),
    "coupling_norms_slice": _sql("e", f"SELECT i, j, {_r('sqrt(sum(e * e))')} AS fn FROM e WHERE a IN (1, 2) AND b IN (1, 2) GROUP BY i, j"),
    "apc_scores": _sql("cn", f"SELECT i, j, {_r('cn')} AS cn FROM cn"),
    "coupling_table": _sql("cn", f"SELECT i, '-' AS a_i, j, '-' AS a_j, 0 AS zero, {_r('cn')} AS score FROM cn"),
    "top_couplings": _sql("cn", f"SELECT i, j, {_r('cn')} AS cn FROM (SELECT * FROM cn ORDER BY cn DESC, i, j LIMIT 10)"),
    "couplings_above": _sql("cn", f"SELECT i, j, {_r('cn')} AS cn FROM cn WHERE cn > 0.01"),
    "variance_priors": _sql("pri", f"SELECT i, j, {_r('v', 9)} AS v, {_r('lam', 3)} AS \"lambda\" FROM pri"),
    "prior_stats": _sql("pri", f"""SELECT {_r('log10(avg(CASE WHEN x > 0 THEN 1 / (2 * x) END))', 3)} AS log10_mean_positive,
        avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) * 100 AS percent_positive,
        avg(CASE WHEN x > 0 AND 1 / (2 * x) BETWEEN 0.01 AND 10000 THEN 1.0 ELSE 0.0 END) * 100 AS percent_within,
        {_r('min(lam)', 3)} AS least, {_r('max(lam)', 3)} AS most FROM pri"""),
    "logo_bits": _sql("fi", f"""SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY bits, a) AS INT) AS rank, a, {_r('bits')} AS bits FROM (
        SELECT i, a, f, f * (log2(3) - sum(CASE WHEN f > 0 THEN -f * log2(f) ELSE 0 END) OVER (PARTITION BY i)) AS bits FROM fi) WHERE f > 0.01"""),
    "score_stats": _sql("cn", f"""SELECT {_r('(SELECT stddev_samp(cn) FROM cn)')} AS sd, {_r('(SELECT max(cn) FROM cn)')} AS top,
        {_r('sum(cn * greatest(0.0, 1 - abs(k - least(greatest(0.99 * n + 0.5, 1), n))))')} AS p99
        FROM (SELECT cn, CAST(row_number() OVER (ORDER BY cn) AS DOUBLE) AS k, CAST(count(*) OVER () AS DOUBLE) AS n FROM cn)"""),
    "strong_cells": _sql("e cn", f"""SELECT i, j, a, b, {_r('e')} AS e FROM (
        SELECT e.*, max(abs(e.e)) OVER (PARTITION BY i, j, a) AS r, max(abs(e.e)) OVER (PARTITION BY i, j, b) AS c FROM e
        JOIN (SELECT i, j FROM cn WHERE cn > 0.01) USING (i, j))
        WHERE r > (SELECT 0.5 * max(abs(e)) FROM e) AND c > (SELECT 0.5 * max(abs(e)) FROM e)"""),
    "permuted_couplings": _sql("e", f"""SELECT i, j, CAST((a + 1) % 3 AS INT) AS a, CAST((b + 1) % 3 AS INT) AS b, {_r('e')} AS e FROM e"""),
    "score_matrix": _sql("cn sites", f"""SELECT x.i, y.i AS j, {_r('coalesce(u.cn, v.cn, 0.0)')} AS cn
        FROM (SELECT DISTINCT i FROM sites) x CROSS JOIN (SELECT DISTINCT i FROM sites) y
        LEFT JOIN cn u ON u.i = x.i AND u.j = y.i LEFT JOIN cn v ON v.j = x.i AND v.i = y.i"""),
    "score_histogram": _sql("cn", f"""SELECT CAST(k AS INT) AS bin, {_r('lo + k * (hi - lo) / 20')} AS lo, {_r('lo + (k + 1) * (hi - lo) / 20')} AS hi,
        (SELECT count(*) FROM cn WHERE least(floor((cn - lo) / ((hi - lo) / 20)), 19) = k) AS n
        FROM range(0, 20) r(k), (SELECT min(cn) AS lo, max(cn) AS hi FROM cn)"""),
    "weighted_sample": _sql("w ne", """SELECT s, count(*) AS times FROM (
        SELECT s, sum(w) OVER (ORDER BY s) - w AS lo, sum(w) OVER (ORDER BY s) AS hi FROM w)
        JOIN (SELECT (k - CAST(0.5 AS DOUBLE)) / 64 * (SELECT neff FROM ne) AS u FROM range(1, 65) r(k)) ON u > lo AND u <= hi GROUP BY s"""),
}

#: Queries of the same rows under a second name.
for _name in ("msa_encode", "msa_valid_rows", "msa_skipped_rows", "alignment_lengths", "neighbor_counts_documents", "neighbor_counts", "seq_weights",
              "site_marginals", "pair_marginals", "coupling_table"):
    ORACLES[f"{_name}_whole"] = ORACLES[_name]
