"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

Rows are taken by turn (nulls first), rows of one turn by role and digest. The first fault of a row counts: blank (no
character but white space), duplicate (role and text seen earlier), truncated (last character that isn't white space is
none of ``.!?``). Edits: Keep 0; Rerole to user or assistant 2; Delete 3, a must for blank and duplicate rows; Insert an empty user or
assistant turn 2; each truncated row that stays adds 1. Role initials of the result match ``(s?(ua)+)?``. Of cheapest
edits those whose initials come first in ASCII order are taken.

1. Rows are dealt by ranges of (conversation, turn, ...) and sorted, and written as pieces of one conversation, of bounded rows and
   bytes. A conversation inside a range is one piece; only those at a range's ends or beyond the bound have several.
2. Pieces are bucketed by length. A tensor (turn, state, piece) holds the least costs from each turn on, filled from the last turn
   to the first for all pieces of a bucket at once; edits are traced from the first to the last the same way.
3. A conversation of several pieces: each piece gives its costs from every state to every state. One stream of these small rows, from the
   last piece to the first, gives the costs at each piece's end; tracing each piece from every state
   and one stream forwards give the state it starts in; then all pieces are traced at once, as in 2.

So a conversation that holds a third of all rows is worked on by many tasks; only rows of one piece each (:func:`report`:
repaired pieces, hashed as they pass) meet in one stream, of bounded memory.

Defined cases: null roles and texts count as one space; a role whose initial is none of s, u, a can't be kept; rows without a
conv_id are one conversation; an empty table gives no rows; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import discard, saved

SPACE = r"\x20\x09-\x0D"
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or re-roled turn, by state.
TURN = np.array([USER, USER, ASSISTANT, USER])
NAMES = {USER: "user", ASSISTANT: "assistant"}
OTHER = 3
#: State after a kept turn, by state and initial (s, u, a, other); 4 is none.
KEEP = np.array([[SYSTEM, USER, 4, 4], [4, USER, 4, 4], [4, 4, ASSISTANT, 4], [4, USER, 4, 4]])
FINE, BLANK, DUPLICATE, TRUNCATED, PADDING = range(5)
_FAR = 1 << 40


@dataclass(frozen=True)
class RepairParams:
    delete: int = 3
    rerole: int = 2
    insert: int = 2
    truncated: int = 1
    #: Bounds of a piece; a longer row is a piece of its own.
    piece_rows: int = 512
    piece_bytes: int = 1 << 20


# Costs and edits of a bucket of pieces ---------------------------------------------------


def _closed(cost: np.ndarray, p: RepairParams) -> np.ndarray:
    """``cost`` (state, piece) where turns may be inserted first; two at most are of use."""
    for _ in range(2):
        cost = np.minimum(cost, p.insert + cost[TURN])
    return cost


def finished(n: int, p: RepairParams) -> np.ndarray:
    """Costs of the end of a conversation: nothing and whole exchanges may end it."""
    end = np.full((4, n), _FAR, np.int64)
    end[[START, ASSISTANT]] = 0
    return _closed(end, p)


def backward(fault: np.ndarray, initial: np.ndarray, end: np.ndarray, p: RepairParams) -> np.ndarray:
    """(turn + 1, state, piece): least cost of all that follows. ``fault`` and ``initial`` are (turn, piece), ``end`` (state, piece)."""
    turns, n = fault.shape
    cost = np.empty((turns + 1, 4, n), np.int64)
    cost[turns] = end
    for t in range(turns - 1, -1, -1):
        after = cost[t + 1]
        wide = np.concatenate([after, np.full((1, n), _FAR, np.int64)])
        extra = np.where(fault[t] == TRUNCATED, p.truncated, 0)
        extra = np.where((fault[t] == BLANK) | (fault[t] == DUPLICATE), _FAR, extra)
        keep = np.take_along_axis(wide, KEEP[:, initial[t]], axis=0) + extra
        least = np.minimum(np.minimum(p.delete + after, keep), p.rerole + extra + after[TURN])
        cost[t] = np.where(fault[t] == PADDING, after, _closed(least, p))
    return cost


def trace(fault: np.ndarray, initial: np.ndarray, cost: np.ndarray, state: np.ndarray, last: bool, p: RepairParams) -> tuple[np.ndarray, np.ndarray]:
    """(piece, step) edits as ASCII codes, 0 for none, and the states at the end. Each step takes the first letter that
    stays cheapest. Turns after the last row are inserted where ``last``, else they belong to the next piece."""
    turns, n = fault.shape
    every, state = np.arange(n), state.copy()
    out = np.zeros((3 * turns + 2, n), np.uint8)
    for t in range(turns):
        live = fault[t] != PADDING
        extra = np.where(fault[t] == TRUNCATED, p.truncated, 0)
        for k in range(2):
            want = cost[t][state, every]
            insert = live & (p.delete + cost[t + 1][state, every] != want) & (p.insert + cost[t][TURN[state], every] == want)
            out[3 * t + k][insert] = ord("I")
            state = np.where(insert, TURN[state], state)
        want = cost[t][state, every]
        wide = np.concatenate([cost[t + 1], np.full((1, n), _FAR, np.int64)])
        kept = KEEP[state, initial[t]]
        sound = (fault[t] != BLANK) & (fault[t] != DUPLICATE)
        delete = live & (p.delete + cost[t + 1][state, every] == want)
        keep = live & ~delete & sound & (extra + wide[kept, every] == want)
        rerole = live & ~delete & ~keep
        for mask, letter in ((delete, "D"), (keep, "K"), (rerole, "R")):
            out[3 * t + 2][mask] = ord(letter)
        state = np.where(keep, kept, np.where(rerole, TURN[state], state))
    if last:
        for k in range(2):
            insert = (state == SYSTEM) | (state == USER)
            out[3 * turns + k][insert] = ord("I")
            state = np.where(insert, TURN[state], state)
    return out.T, state


def _buckets(lengths: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(turns, pieces): pieces by length, the length a power of two."""
    found: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        found[1 << (n - 1).bit_length()].append(i)
    yield from found.items()


def _tensor(values: list[np.ndarray], own: list[int], turns: int, fill: int) -> np.ndarray:
    out = np.full((turns, len(own)), fill, np.int8)
    for k, i in enumerate(own):
        out[: len(values[i]), k] = values[i]
    return out


# Pieces ----------------------------------------------------------------------------------


def _keyed(turns: DataFrame) -> DataFrame:
    """Rows with what their order and faults need: the digest tells apart role and text."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    return rows.select(
        "conv_id", "turn", "role", "text", F.unhex(F.md5(F.concat(F.col("role"), F.lit("\0"), F.col("text")))).alias("digest"),
        F.when(blank, BLANK).when(whole, FINE).otherwise(TRUNCATED).cast("tinyint").alias("fault"),
        (F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1).alias("initial"),
    ).withColumn("initial", F.when(F.length("role") == 0, OTHER).when(F.col("initial") < 0, OTHER).otherwise(F.col("initial")).cast("tinyint"))


_PIECE = {
    "part": pa.int32(), "at": pa.int64(), "whole": pa.bool_(), "turns": pa.list_(pa.int64()), "roles": pa.list_(pa.string()),
    "texts": pa.list_(pa.string()), "digests": pa.list_(pa.binary()), "faults": pa.list_(pa.int8()), "initials": pa.list_(pa.int8()),
}
_PIECE_SQL = (
    "part int, at long, whole boolean, turns array<bigint>, roles array<string>, texts array<string>, digests array<binary>,"
    " faults array<tinyint>, initials array<tinyint>"
)


def pieces(turns: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """(conv_id, part, at, whole, lists of its rows): pieces in the order (part, at). ``whole`` pieces are surely all of
    their conversation. Equal rows are told apart by a number of their own, so that any group can be dealt to several ranges."""
    order = ["conv_id", "turn", F.substring("role", 1, 16), "digest", "_own"]
    rows = _keyed(turns).withColumn("_own", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_own")
    kind = dealt.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        held: dict | None = None  # the piece being filled
        first, split, done, size = True, False, [], 0

        def close(more: bool) -> None:
            """Put away the held piece; ``more`` of its conversation follows, or may follow."""
            nonlocal at, first, split, size
            size += held["bytes"]
            done.append(held | {"part": part, "at": at, "whole": not (first or split or more)})
            at, split = at + 1, more
            first = first and more

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, own in groupby(range(batch.num_rows), key=columns[0].__getitem__):
                if held is not None and held["key"] != key:
                    close(False)
                    held = None
                for i in own:
                    weight = len(columns[3][i]) + len(columns[2][i])
                    if held is not None and (len(held["rows"]) >= p.piece_rows or held["bytes"] + weight > p.piece_bytes):
                        close(True)
                        held = None
                    if held is None:
                        held = {"key": key, "rows": [], "bytes": 0}
                    held["rows"].append([c[i] for c in columns[1:]])
                    held["bytes"] += weight
            if size > 4 * p.piece_bytes:
                yield _piece_batch(done, batch.schema.field(0))
                done, size = [], 0
        if held is not None:
            close(True)  # the next range may go on with it
            yield _piece_batch(done, batch.schema.field(0))

    return dealt.mapInArrow(run, f"conv_id {kind.simpleString()}, {_PIECE_SQL}")


def _piece_batch(done: list[dict], key: pa.Field) -> pa.RecordBatch:
    lists = [[[r[k] for r in x["rows"]] for x in done] for k in range(6)]
    values = [[x["part"] for x in done], [x["at"] for x in done], [x["whole"] for x in done], *lists]
    columns = [pa.array([x["key"] for x in done], key.type)] + [pa.array(v, t) for v, t in zip(values, _PIECE.values(), strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_PIECE])


def _with_duplicates(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Faults of each piece with later rows of a digest, and those that ``seen`` lists, as duplicates."""
    names = batch.schema.names
    digests, faults = batch.column(names.index("digests")).to_pylist(), batch.column(names.index("faults")).to_pylist()
    earlier = batch.column(names.index("seen")).to_pylist() if "seen" in names else [None] * batch.num_rows
    out = []
    for own, fault, before in zip(digests, faults, earlier, strict=True):
        known, found = set(before or ()), []
        for d, f in zip(own, fault, strict=True):
            found.append(DUPLICATE if f != BLANK and d in known else f)
            known.add(d)
        out.append(np.array(found, np.int8))
    return out


def _initials(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.array(x, np.int8) for x in batch.column(batch.schema.names.index("initials")).to_pylist()]


_REPAIRED_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_REPAIRED = {
    "part": pa.int32(), "at": pa.int64(), "n_rows": pa.int64(), "least": pa.int64(), "most": pa.int64(), "distinct": pa.int64(),
    "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first": pa.int8(), "last": pa.int8(),
    "cost": pa.int64(), "audit": pa.string(), "repaired": pa.list_(_REPAIRED_TURN),
}
_REPAIRED_SQL = (
    "part int, at long, n_rows long, least long, most long, distinct long, blank long, duplicate long, truncated long, illegal long,"
    " first tinyint, last tinyint, cost long, audit string, repaired array<struct<role:string,text:string>>"
)


def _legal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether role initials b may follow a: su, ua and au."""
    return ((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2))


def _edited(audit: str, state: int, roles: list[str], texts: list[str], initial: np.ndarray) -> list[dict]:
    out, t = [], 0
    for letter in audit:
        if letter == "I":
            state = int(TURN[state])
            out.append({"role": NAMES[state], "text": ""})
            continue
        if letter == "K":
            state = int(KEEP[state, initial[t]])
            out.append({"role": roles[t], "text": texts[t]})
        elif letter == "R":
            state = int(TURN[state])
            out.append({"role": NAMES[state], "text": texts[t]})
        t += 1
    return out


def _repaired(source: DataFrame, p: RepairParams) -> DataFrame:
    """Edits of each piece; where ``ends``, ``entry`` and ``final`` are given, from that state to those costs."""
    kind = source.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            faults, initials = _with_duplicates(batch), _initials(batch)
            turns, roles, texts = (at[k].to_pylist() for k in ("turns", "roles", "texts"))
            pieced = "entry" in at
            ends = np.array(at["ends"].to_pylist(), np.int64).reshape(-1, 4).T if pieced else finished(batch.num_rows, p)
            entry = np.array(at["entry"].to_pylist(), np.int64) if pieced else np.zeros(batch.num_rows, np.int64)
            final = at["final"].to_pylist() if pieced else [True] * batch.num_rows
            audits, costs = [""] * batch.num_rows, [0] * batch.num_rows
            for size, all_own in _buckets([len(x) for x in faults]):
                for last in (True, False):
                    own = [i for i in all_own if final[i] == last]
                    if not own:
                        continue
                    f, c = _tensor(faults, own, size, PADDING), _tensor(initials, own, size, OTHER)
                    cost = backward(f, c, ends[:, own], p)
                    steps, leaves = trace(f, c, cost, entry[own], last, p)
                    after = np.zeros(len(own), np.int64) if last else ends[leaves, own]
                    spent = cost[0][entry[own], np.arange(len(own))] - after
                    for k, i in enumerate(own):
                        audits[i] = steps[k][steps[k] > 0].tobytes().decode()
                        costs[i] = int(spent[k])
            out: dict[str, list] = {k: [] for k in _REPAIRED}
            for i, (f, c) in enumerate(zip(faults, initials, strict=True)):
                known = [x for x in turns[i] if x is not None]
                values = (
                    at["part"][i].as_py(), at["at"][i].as_py(), len(f), min(known, default=None), max(known, default=None), len(set(known)),
                    int((f == BLANK).sum()), int((f == DUPLICATE).sum()), int((f == TRUNCATED).sum()), int((~_legal(c[:-1], c[1:])).sum()),
                    int(c[0]), int(c[-1]), costs[i], audits[i], _edited(audits[i], int(entry[i]), roles[i], texts[i], c),
                )
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([at["conv_id"], *(pa.array(out[k], t) for k, t in _REPAIRED.items())], names=["conv_id", *_REPAIRED])

    return source.mapInArrow(run, f"conv_id {kind}, {_REPAIRED_SQL}")


# Conversations of several pieces -----------------------------------------------------------


def _seen_earlier(parts: DataFrame) -> DataFrame:
    """``parts`` with ``seen``: digests of each piece that earlier pieces of its conversation have."""
    from pyspark.sql import Window

    flat = parts.select("conv_id", "part", "at", F.explode(F.array_distinct("digests")).alias("d"))
    first = F.min(F.struct("part", "at")).over(Window.partitionBy("conv_id", "d"))
    seen = flat.withColumn("first", first).where(F.struct("part", "at") > F.col("first")).groupBy("part", "at").agg(F.collect_list("d").alias("seen"))
    return parts.join(seen, ["part", "at"], "left")


def _costs_between(parts: DataFrame, p: RepairParams) -> DataFrame:
    """(conv_id, part, at, costs): 16 least costs of a piece, from each state (rows) to each state."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults, initials = _with_duplicates(batch), _initials(batch)
            costs: list = [None] * batch.num_rows
            for size, own in _buckets([len(x) for x in faults]):
                f, c = _tensor(faults, own, size, PADDING), _tensor(initials, own, size, OTHER)
                to = []
                for state in range(4):
                    end = np.full((4, len(own)), _FAR, np.int64)
                    end[state] = 0
                    to.append(backward(f, c, end, p)[0])
                for k, i in enumerate(own):
                    costs[i] = [int(min(to[b][a, k], _FAR)) for a in range(4) for b in range(4)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(x)) for x in ("conv_id", "part", "at")), pa.array(costs, pa.list_(pa.int64()))],
                names=["conv_id", "part", "at", "costs"])

    return parts.mapInArrow(run, f"conv_id {kind}, part int, at long, costs array<bigint>")


def _streamed(small: DataFrame, forwards: bool, step, start, schema: str, names: list[str]) -> DataFrame:
    """Rows of each conversation one after the other: ``step(state, row)`` gives the next state and a row."""
    order = [F.col(c).asc() if forwards else F.col(c).desc() for c in ("part", "at")]
    dealt = small.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != key:
                    key, state, begun = row["conv_id"], start(), True
                state, found = step(state, row)
                out.append(found)
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(names))

    return dealt.mapInArrow(run, schema)


def _arrow(names: list[str]) -> pa.Schema:
    kinds = {"part": pa.int32(), "at": pa.int64(), "ends": pa.list_(pa.int64()), "final": pa.bool_(), "entry": pa.int64()}
    return pa.schema([(n, kinds[n]) for n in names])


def _exits(parts: DataFrame, p: RepairParams) -> DataFrame:
    """(conv_id, part, at, exits): the state in which a piece ends, from each state."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            faults, initials = _with_duplicates(batch), _initials(batch)
            ends = np.array(batch.column(names.index("ends")).to_pylist(), np.int64).reshape(-1, 4).T
            exits: list = [None] * batch.num_rows
            for size, own in _buckets([len(x) for x in faults]):
                f, c = _tensor(faults, own, size, PADDING), _tensor(initials, own, size, OTHER)
                cost = backward(f, c, ends[:, own], p)
                leaves = [trace(f, c, cost, np.full(len(own), s), False, p)[1] for s in range(4)]
                for k, i in enumerate(own):
                    exits[i] = [int(x[k]) for x in leaves]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(x)) for x in ("conv_id", "part", "at")), pa.array(exits, pa.list_(pa.int64()))],
                names=["conv_id", "part", "at", "exits"])

    return parts.mapInArrow(run, f"conv_id {kind}, part int, at long, exits array<bigint>")


def _linked(parts: DataFrame, p: RepairParams) -> DataFrame:
    """``parts`` with ends, final and entry: costs after the piece, whether none follows, the state it starts in."""
    end = finished(1, p)[:, 0].tolist()

    def back(state, row):
        after, last = state
        between = np.array(row["costs"]).reshape(4, 4)
        before = _closed((between + np.array(after)).min(axis=1)[:, None], p)[:, 0].tolist()
        return (before, False), {"part": row["part"], "at": row["at"], "ends": after, "final": last}

    def forth(state, row):
        return row["exits"][state], {"part": row["part"], "at": row["at"], "entry": state}

    ends = saved(_streamed(
        _costs_between(parts, p), False, back, lambda: (end, True), "part int, at long, ends array<bigint>, final boolean", ["part", "at", "ends", "final"]), "repair-ends")
    known = parts.join(ends, ["part", "at"])
    entries = _streamed(_exits(known, p), True, forth, lambda: START, "part int, at long, entry long", ["part", "at", "entry"])
    return known.join(entries, ["part", "at"])


def repair(turns: DataFrame, p: RepairParams = RepairParams()) -> tuple[DataFrame, DataFrame]:
    """Repaired pieces (conv_id, part, at, counts, cost, audit, repaired) of ``turns`` (conv_id, turn, role, text): those that are
    whole conversations, and those of conversations of several pieces, in the order (part, at)."""
    all_pieces = saved(pieces(turns, p), "repair-pieces")
    alone = _repaired(all_pieces.where("whole"), p)
    parts = saved(_seen_earlier(all_pieces.where("not whole")), "repair-parts")
    return alone, _repaired(_linked(parts, p), p)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def report(alone: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the results of :func:`repair`.
    The pieces of a conversation pass one after the other; they are hashed and forgotten."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    whole = alone.select("conv_id", gaps, *_COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    kind = parts.schema["conv_id"].dataType.simpleString()
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def row() -> dict:
            gaps = held["most"] - held["least"] + 1 - held["distinct"] if held["most"] is not None else 0
            return {"conv_id": held["key"], "gaps": gaps, **{k: held[k] for k in _COUNTS}, "audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if held is None or held["key"] != x["conv_id"]:
                    if held is not None:
                        out.append(row())
                    held = {"key": x["conv_id"], "hash": hashlib.sha256(), "any": False, "audit": [], "least": None, "most": None, "distinct": 0, "last": None}
                    held |= dict.fromkeys(_COUNTS, 0)
                for k in _COUNTS:
                    held[k] += x[k]
                if held["last"] is not None and not _legal(np.array(held["last"]), np.array(x["first"])):
                    held["illegal"] += 1
                held["last"] = x["last"]
                held["distinct"] += x["distinct"] - (held["most"] is not None and held["most"] == x["least"])
                if x["most"] is not None:
                    held["least"] = x["least"] if held["least"] is None else held["least"]
                    held["most"] = x["most"]
                held["audit"].append(x["audit"])
                for t in x["repaired"]:
                    held["hash"].update((("\n" if held["any"] else "") + f"{t['role']}:{t['text']}").encode())
                    held["any"] = True
            yield _report_batch(out, batch.schema.field(0))
        if held is not None:
            yield _report_batch([row()], batch.schema.field(0))

    streamed = dealt.mapInArrow(
        run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return whole.union(streamed)


def _report_batch(rows: list[dict], key: pa.Field) -> pa.RecordBatch:
    kinds = [("conv_id", key.type), ("gaps", pa.int64()), *((k, pa.int64()) for k in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by k = crc32("conv_id:turn") mod 20: 0 drops a row, 1 empties its text, 2 removes the text's
    ``.!?``, 3 repeats the row, 4 makes the role user. Nulls count as one space first."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k: Column = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), k.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_k") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")
