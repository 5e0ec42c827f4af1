"""Conversation repair against an exhaustive search over edits."""

import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import conversation_repair as C
from lattica.llm import queries as Q

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = "".join(c for c in text if c not in ".!?")
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (k != 0) * (2 if k == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role[:16], hashlib.md5(f"{role}\0{text}".encode()).digest())


def expected(conv, rows):
    """The report of one conversation by trying all edits; the state is the result so far, shortened."""
    rows = sorted(rows, key=order)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "dup" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def follows(state, c):  # state: what came before: "" (nothing), s, u or a
        return c in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    @functools.cache
    def best(t, state, inserted):
        found = []
        if t == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for c, name in (("u", "user"), ("a", "assistant")):
                if follows(state, c):
                    cost, audit, turns = best(t, c, inserted + 1)
                    found.append((cost + 2, "I" + audit, (f"{name}:", *turns)))
        if t < len(rows):
            _, _, role, text = rows[t]
            cost, audit, turns = best(t + 1, state, 0)
            found.append((cost + 3, "D" + audit, turns))
            if faults[t] not in ("blank", "dup"):
                extra = faults[t] == "cut"
                if role[:1] and role[0] in "sua" and follows(state, role[0]):
                    cost, audit, turns = best(t + 1, role[0], 0)
                    found.append((cost + extra, "K" + audit, (f"{role}:{text}", *turns)))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if follows(state, c):
                        cost, audit, turns = best(t + 1, c, 0)
                        found.append((cost + 2 + extra, "R" + audit, (f"{name}:{text}", *turns)))
        return min(found, default=(10**6, "", ()))

    cost, audit, turns = best(0, "", 0)
    known = [t for _, t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (conv, gaps, faults.count("blank"), faults.count("dup"), faults.count("cut"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def made_up(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?", " ", "", None, "Fine!\n", "x. y", f"t{rng.randrange(4)}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def check(got, rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    found = {r.conv_id: tuple(r) for r in got.select(*COLUMNS).collect()}
    assert found == {c: expected(c, own) for c, own in by.items()}


@pytest.mark.parametrize("piece_rows", [1, 3, 512])
def test_report_equals_an_exhaustive_search(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in made_up(rng, 150)]
    got = C.report(*C.repair(spark.createDataFrame(rows, SCHEMA), C.RepairParams(piece_rows=piece_rows)))
    check(got, rows)


def test_one_conversation_is_dealt_to_many_tasks(spark):
    rng = random.Random(9)
    rows = [(5, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c.", "d", f"{t}."])) for t in range(400)]
    rows += [(5, 77, "user", "same.")] * 300 + [(c, 0, "user", "hi.") for c in range(20) if c != 5]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = C.RepairParams(piece_rows=64)
        parts = C.pieces(spark.createDataFrame(rows, SCHEMA), p)
        sizes = parts.groupBy("part").agg(F.sum(F.size("turns")).alias("n"), F.max(F.size("turns")).alias("most")).collect()
        assert max(r.n for r in sizes) < len(rows) / 3 and max(r.most for r in sizes) <= 64
        import sys
        sys.setrecursionlimit(20000)
        check(C.report(*C.repair(spark.createDataFrame(rows, SCHEMA), p)), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rows = made_up(random.Random(4), 120)
    gone = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = damage(rows)
    by = {c: [r for r in left if r[0] == c] for c in {r[0] for r in rows}}
    got = Q.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == COLUMNS
    found = {r.conv_id: tuple(r) for r in got.collect()}
    assert len(found) == got.count()
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert found == {c: expected(c, own) if own else (c, *nothing) for c, own in by.items()}
    assert found[gone] == (gone, *nothing)


def test_empty_table(spark):
    assert C.report(*C.repair(spark.createDataFrame([], SCHEMA))).count() == 0
