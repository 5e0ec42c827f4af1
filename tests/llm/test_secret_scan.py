"""Secret scans against a plain version: regular expressions, the tests' formulas, the e-BH rule."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import pytest

from lattica.llm import queries as Q
from lattica.llm import secret_scan as S

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WHOLE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABETS = [
    ("0123456789abcdef", "0123456789abcdef"), ("0123456789ABCDEF", "0123456789ABCDEF"),
    ("abcdefghijklmnopqrstuvwxyz", ""), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",) * 2, ("0123456789abcdefghijklmnopqrstuvwxyz",) * 2,
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",) * 2,
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",) * 2,
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",) * 2,
]
CLASSES = {"digit": "0123456789", "capital": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "af": "abcdef", "gz": "ghijklmnopqrstuvwxyz", "sign": "+/_-"}


def base(text):
    out = {"assign": [], "access": [], "hex": []}
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out["assign"].append(m.span())
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)):
        out[kind] = [m.span() for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return out


def battery(body, alphabet):
    n, size = len(body), len(alphabet)
    v = [alphabet.index(c) for c in body]
    bins = max(2, min(size, n // 4))
    seen = Counter(x * bins // size for x in v)
    width = Counter(x * bins // size for x in range(size))
    chi = sum(seen[b] ** 2 / (n * width[b] / size) for b in range(bins)) - n
    k = bins - 1
    z = ((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    p = [math.erfc(z / math.sqrt(2)) / 2]
    turns = sum((a * 2 >= size) != (b * 2 >= size) for a, b in zip(v, v[1:]))
    p.append(math.erfc(abs((turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)) / math.sqrt(2)))
    mean, var = (size - 1) / 2, (size * size - 1) / 12
    r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / var / (n - 1)
    p.append(math.erfc(abs(r * math.sqrt(n - 1)) / math.sqrt(2)))
    half = -sum(math.log(max(x, 1e-12)) for x in p)
    return math.exp(-half) * (1 + half + half * half / 2)


def expected(texts):
    """{row: (base spans by kind, added spans)}."""
    count = {k: sum(t.count(c) for t in texts for c in chars) for k, chars in CLASSES.items()}
    total = sum(count.values()) + 5
    logs = {k: math.log((count[k] + 1) / total / len(chars)) for k, chars in CLASSES.items()}
    tested = []
    for i, text in enumerate(texts):
        held = [m.span() for m in ASSIGN.finditer(text)]
        for m in WHOLE.finditer(text):
            body = m[0].rstrip("=")
            if len(body) < 16 or any(a < m.end() and m.start() < b for a, b in held) or any(re.search(x, m[0]) for x in ("AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}")):
                continue
            if all(c in "0123456789" for c in body):
                continue
            alphabet = next((a for chars, a in ALPHABETS if set(body) <= set(chars)), "")
            if alphabet:
                log_e = sum(-math.log(len(alphabet)) - next(logs[k] for k, x in CLASSES.items() if c in x) for c in body)
                tested.append((i, m.start(), m.end(), len(body), battery(body, alphabet), log_e))
    added = {i: [] for i in range(len(texts))}
    for lo, hi in ((16, 24), (24, 32), (32, 64), (64, 10**9)):
        own = [x for x in tested if lo <= x[3] < hi]
        passing = [x for x in own if x[4] >= 0.01]
        steps = sorted({max(-1, math.floor(x[5] * 8)) for x in passing}) or [0]
        good = [s for s in steps if (k := sum(max(-1, math.floor(x[5] * 8)) >= s for x in passing)) and s / 8 >= math.log(len(own) / (0.05 * k))]
        for x in passing:
            if good and x[5] >= min(good) / 8:
                added[x[0]].append((x[1], x[2]))
    return {i: (base(t), sorted(added[i])) for i, t in enumerate(texts)}


def texts():
    rng = random.Random(7)
    words = "the of and einheit verschiebung than theonreality inhalt wasserstoff Zusammenfassung été".split()
    out = []
    for i in range(300):
        own = [rng.choice(words) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            secret = rng.choice([
                base64.b64encode(rng.randbytes(rng.choice([15, 24, 40, 70]))).decode(), rng.randbytes(16).hex().upper(), rng.randbytes(20).hex(), rng.randbytes(9).hex(),
                base64.urlsafe_b64encode(rng.randbytes(33)).decode(), base64.b32encode(rng.randbytes(20)).decode(), "AKIA" + base64.b32encode(rng.randbytes(10)).decode(),
                f'api_key="{rng.randbytes(6).hex()}"', f"PassWord : {rng.randbytes(3).hex()}", f"Token={rng.randbytes(20).hex()}", "4465758382889437", "ZUSAMMENFASSUNGEN",
                "einheitverberbeeinheitkeit", "getElementsByTagNameAndClass", "token: 'secret: abcdefghijk", "a" * 40, "AKIAAKIA", "xxxxxxxxxxxxxxxxtoken=abcdefghijklmnop",
                "2024-01-15-2024-01-16", "AbCdEfGhIjKlMnOpQrStUvWxYz012345", "deadbeef" * 5])
            own.insert(rng.randrange(len(own) + 1), secret)
        out.append(rng.choice([" ", "  ", "\n", "\x01", "😀 "]).join(own))
    return [*out, "", " ", "token=" + "x" * 5000, ("0f" * 20 + " ") * 200, "\x01" * 5 + "secret='abcdefgh'", "ſecret=abcdefghi toKen=abcdefghi"]


def joined(kinds):
    order = ("assign", "access", "hex", "random")
    flat = sorted((s, order.index(k), e) for k, spans in kinds.items() for s, e in spans)
    return ",".join(f"{order[k]}:{s}:{e}" for s, k, e in flat)


def test_query_equals_the_plain_version(spark, tmp_path):
    rows = texts()
    want = expected(rows)
    assert sum(len(x[1]) for x in want.values()) > 30  # the battery finds some
    spark.createDataFrame([*enumerate(rows), (None, None), (None, None)], "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS spans", "1 AS _text", "2 AS _runs").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op11_secret_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    found = got.collect()
    assert len(found) == len(rows) + 2
    for r in found:
        own, added = want[r.doc_id] if r.doc_id is not None else (base(""), [])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(own[k]) for k in ("assign", "access", "hex")), rows[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined(own).encode()).hexdigest()
        assert r.spans == joined(own | {"random": added}), rows[r.doc_id]


def test_no_words_of_natural_text_are_secrets(spark):
    rng = random.Random(3)
    parts = ["than", "tion", "heit", "keit", "ment", "the", "ver", "sch", "Ein", "eaux", "ing"]
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(60))) for i in range(200)]
    found = S.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert found.selectExpr("sum(size(random)) AS n").first().n == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={i:08d}" for i in range(3000))
    row = S.scan(spark.createDataFrame([(text,)], "text string"), []).first()
    assert [tuple(x) for x in row.assign] == [m.span() for m in re.finditer(r"token=\d+", text)]


@pytest.mark.parametrize("z", [-3.0, -0.4, 0.0, 1.2, 4.0])
def test_upper_tail(spark, z):
    from pyspark.sql import functions as F

    assert spark.range(1).select(S.upper_tail(F.lit(z)).alias("p")).first().p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=2e-7)


def test_empty_table_and_no_python_in_the_plan(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = S.scan(docs, ["doc_id"])
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().toString()


def test_sql_gives_the_same_spans(tmp_path):
    import duckdb
    import pandas as pd

    rows = texts()
    want = expected(rows)
    c = duckdb.connect()
    frame = pd.DataFrame({"doc_id": range(len(rows)), "text": rows})  # noqa: F841
    c.execute("CREATE VIEW documents AS SELECT * FROM frame")
    found = c.execute(Q.oracle_sql()["op11_secret_scan"]).fetchall()
    assert len(found) == len(rows)
    for doc_id, *counts, digest, spans in found:
        own, added = want[doc_id]
        assert counts == [len(own[k]) for k in ("assign", "access", "hex")]
        assert digest == hashlib.sha256(joined(own).encode()).hexdigest() and spans == joined(own | {"random": added}), rows[doc_id]
