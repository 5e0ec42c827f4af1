"""Periodic runs against a direct search, with texts as the query changes them."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import periodic_runs as R
from lattica.llm import queries as Q


def direct(w: list) -> list[tuple[int, int, int]]:
    """All runs by comparing all words at all lags."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def found(words: list) -> list[tuple[int, int, int]]:
    ids = R.word_numbers(words)
    first, tops = np.array([0, len(ids)]), np.array([len(ids) // 4])
    matches, _ = R.lag_matches(ids, first, tops)
    assert list(matches[1:]) == [sum(words[i] == words[i + q] for i in range(len(words) - q)) for q in range(1, tops[0] + 1)]
    return R.runs_of(ids, matches)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_runs_equal_a_direct_search(blocks):
    words = [str(x).encode() for block, times in blocks for x in block * times]
    assert found(words) == direct(words)


def test_frequent_words_are_counted_by_transforms(monkeypatch):
    rng = random.Random(5)
    words = [rng.choice([b"a", b"a", b"b", b"c%d" % rng.randrange(40)]) for _ in range(700)]
    called = []
    counted = R.autocorrelation
    monkeypatch.setattr(R, "_FFT_COST", 0.2)
    monkeypatch.setattr(R, "autocorrelation", lambda *a: called.append(1) or counted(*a))
    assert found(words) == direct(words)
    assert called


@pytest.mark.parametrize("words", [[b"a"] * 50_000, [b"a", b"b"] * 25_000, [b"x%d" % (i % 7000) for i in range(50_000)]])
def test_one_period_fills_a_long_text(words):
    ids = R.word_numbers(words)
    matches, _ = R.lag_matches(ids, np.array([0, len(ids)]), np.array([len(ids) // 4]))
    period = len(set(words))
    assert R.runs_of(ids, matches) == [(0, len(words), period)]


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = direct(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def test_query_equals_the_direct_search(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "a b " * 6), (1, None), (2, ""), (3, " \x0b\n"), (4, "é " * 9), (4, "é " * 9), (5, "a a a a a"), (6, "a a a a a a")]
    for i in range(7, 160):
        rows.append((i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(120)))))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(7, 160)) > 5
    spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_words int, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, start int")
    assert R.find_runs(docs, ["doc_id", "start"]).count() == 0
    docs = spark.createDataFrame([(1, "x " * 8, 3)], "doc_id long, text string, start int")
    row = R.find_runs(docs, ["doc_id", "start"]).first()
    assert (row.start, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (3, 8, [(0, 8, 1)], "x")
