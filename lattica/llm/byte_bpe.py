"""Byte-level BPE encoding and decoding.

1. An Arrow function splits texts by the vocabulary's pattern, and pieces again where no
   entry of the vocabulary can cross (see :class:`Cuts`). Each distinct part of its
   partition is sent down once, before the first text that uses it; a text becomes the
   list of its parts' numbers.
2. Spark higher-order functions encode the parts: the bytes of a part are the
   initial symbols, and a fold merges the adjacent pair of least rank (the leftmost of
   equals) until no pair has a rank. Ranks come from a table of one row, read as a scalar
   subquery so that no plan spells it out: the map from two symbols to their merge laid
   out in arrays (:class:`PairRanks`), so that a look-up reads one entry.
3. A second Arrow function puts the ids of each text together and decodes them by
   concatenating the vocabulary's binary pieces.

All three run in one stage without a shuffle: rows keep their order, a lost task is
run again as a whole, and memory is bounded by ``distinct_bytes`` of remembered pieces.
The fold takes time with the square of a part's length, so a part of more than
``fold_bytes`` (an unbroken run of letters, say) is merged by a queue in the second function.

Defined cases: a null or empty text has no ids; special strings are ordinary text; a
byte without a rank in the vocabulary is a ValueError; every whole text is encoded, also
pieces of any length; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.arrays import chunks, give_back, gives_back

#: Symbols have this many bits; no merge has this rank; places in a part that the fold merges have this many bits.
SYMBOL_BITS = 20
NO_RANK = 1 << SYMBOL_BITS
PLACE_BITS = 9


@dataclass(frozen=True)
class BpeParams:
    #: Bytes of distinct pieces that a task remembers at most.
    distinct_bytes: int = 10 << 20
    #: Longest part that the fold merges (less than 2**PLACE_BITS - 1).
    fold_bytes: int = 256
    #: Least text of a task: a task encodes each of its distinct parts once, so small tasks repeat each other's work.
    task_bytes: int = 100 << 20
    #: Numbers of parts that are put together at once.
    joined_parts: int = 1 << 17
    #: Bytes of text that are split at once.
    chunk_bytes: int = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with Path(path).open("rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass(frozen=True)
class PairRanks:
    """The ranked merges as arrays: symbols ``a`` and ``b`` merge into ``merged[shift[a] + b]``
    where ``owner[shift[a] + b]`` is ``a``. A symbol's number is its rank, which orders merges too."""

    shift: list[int]
    owner: list[int]
    merged: list[int]

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> PairRanks:
        size = max(ranks.values(), default=0) + 1
        if size >= NO_RANK:
            raise ValueError(f"ranks must be less than {NO_RANK - 1}")
        rows: dict[int, list[tuple[int, int]]] = {}
        for x, i in ranks.items():
            for k in range(1, len(x)):
                left, right = ranks.get(x[:k]), ranks.get(x[k:])
                if left is not None and right is not None:
                    rows.setdefault(left, []).append((right, i))
        span = 1 << (4 * sum(map(len, rows.values())) + size).bit_length()
        owner, merged = np.full(span, -1, np.int64), np.full(span, -1, np.int64)
        shift = np.full(size, span, np.int64)  # out of the arrays where a symbol begins no merge
        draw = np.random.RandomState(7)
        # symbols with many merges find room first; each takes a shift at which all its places are free
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            right, tries = np.array([x for x, _ in row]), 16
            while True:
                at = draw.randint(0, span - size, tries)
                for x in right.tolist():
                    at = at[owner[at + x] < 0]
                    if not len(at):
                        break
                if len(at):
                    break
                tries = min(2 * tries, 1 << 20)
            shift[left] = at[0]
            owner[at[0] + right] = left
            merged[at[0] + right] = [i for _, i in row]
        return cls(shift.tolist(), owner.tolist(), merged.tolist())


def tables(spark: SparkSession, ranks: PairRanks) -> Column:
    """``ranks`` as a struct of arrays: a plan names the subquery, not its millions of digits."""
    row = pa.table({x: pa.array([getattr(ranks, x)], pa.list_(pa.int32())) for x in ("shift", "owner", "merged")})
    return spark.createDataFrame(row).select(F.struct("shift", "owner", "merged")).scalar()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: the finish of a fold over nothing. An item of a one-entry array does
    so too, but looks up the type of its whole body at each call."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def encode_part(symbols: Column, ranks: Column) -> Column:
    """array<int> of the ids of a part: ``symbols`` are the numbers of its bytes between two -1, ``ranks`` are :func:`tables`.

    The state of the fold is one number for each symbol: the rank of its merge with the next one above,
    its place among the bytes of the part, the symbol below. The least number is thus the leftmost merge
    of least rank, and no other number equals it. The -1 before the part stays its first entry."""
    rest, low_bits = F.lit(NO_RANK), PLACE_BITS + SYMBOL_BITS

    def symbol(x: Column) -> Column:
        return x.bitwiseAND(F.lit(NO_RANK - 1)).cast("int")

    def fold(shift: Column, owner: Column, merged: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            slot = F.get(shift, left) + right
            found = F.when(F.get(owner, slot) == left, F.get(merged, slot))
            return F.shiftleft(F.coalesce(found, rest).cast("long"), low_bits)

        def step(state: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                def put(at: Column) -> Column:
                    new = F.shiftright(least, low_bits).cast("int")
                    before, after = F.get(state, at - 2), F.get(state, at + 1)
                    place = least.bitwiseAND(F.lit((1 << low_bits) - NO_RANK))
                    pair = F.array(
                        rank(symbol(before), new).bitwiseOR(before.bitwiseAND(F.lit((1 << low_bits) - 1))),
                        rank(new, symbol(after)).bitwiseOR(place).bitwiseOR(new.cast("long")),
                    )
                    return F.concat(F.slice(state, F.lit(1), at - 2), pair, F.slice(state, at + 2, rest))

                at = F.array_position(state, least).cast("int")
                return F.when(least >= F.lit(NO_RANK << low_bits), state).otherwise(_let(at, put))

            return _let(F.array_min(state), merge)

        def entry(x: Column, i: Column) -> Column:
            own = x.bitwiseAND(F.lit(NO_RANK - 1)).cast("long")
            return rank(x, F.get(symbols, i + 1)).bitwiseOR(F.shiftleft(i.cast("long"), SYMBOL_BITS)).bitwiseOR(own)

        entries = F.transform(F.slice(symbols, F.lit(1), F.size(symbols) - 1), entry)
        merges = F.slice(symbols, F.lit(1), F.greatest(F.size(symbols) - 3, F.lit(0)))  # as many as there can be
        return F.aggregate(merges, entries, step, lambda x: F.transform(F.slice(x, F.lit(2), rest), symbol))

    return _let(ranks, lambda t: _let(t["shift"], lambda x: _let(t["owner"], lambda y: _let(t["merged"], lambda z: fold(x, y, z)))))


def byte_symbols(parts: list[bytes | None], number: np.ndarray) -> pa.Array:
    """What :func:`encode_part` takes; null for a null."""
    data = np.frombuffer(b"".join(x for x in parts if x is not None), np.uint8)
    n = np.array([0 if x is None else len(x) + 2 for x in parts], np.int64)
    edge = np.concatenate([[0], np.cumsum(n)])
    values = np.full(edge[-1], -1, np.int32)
    inside = np.ones(edge[-1], bool)
    own = n > 0
    inside[edge[:-1][own]] = inside[edge[1:][own] - 1] = False
    values[inside] = number[data]
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values), mask=pa.array(~own) if not own.all() else None)


class Cuts:
    """Places in a piece that no merge can cross.

    An entry that crosses the place between two bytes is the two bytes alone, or holds them
    with the byte before or after: where neither the two nor one of the three-byte runs
    occurs in the vocabulary, both sides merge as if they were pieces of their own."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.two = np.zeros(1 << 16, bool)
        for x in ranks:
            if len(x) == 2:
                self.two[x[0] << 8 | x[1]] = True
        self.three = np.unique(np.array([x[i] << 16 | x[i + 1] << 8 | x[i + 2] for x in ranks for i in range(len(x) - 2)], np.int64))

    def parts(self, pieces: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all pieces, bounds of their parts in these, and by piece the first of its parts."""
        data = b"".join(pieces)
        x = np.frombuffer(data, np.uint8).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        cut = np.zeros(len(x) + 1, bool)
        if len(x) > 1:
            ends = np.zeros(len(x) + 2, bool)
            ends[start] = True
            three = np.zeros(len(x) + 1, bool)  # by first byte; runs over the end of a piece don't count
            at = np.flatnonzero(~self.two[x[:-1] << 8 | x[1:]] & ~ends[1 : len(x)])
            near = np.unique(np.concatenate([at - 1, at]))
            near = near[(near >= 0) & (near + 2 < len(x))]
            near = near[~ends[near + 1] & ~ends[near + 2]]
            code = x[near] << 16 | x[near + 1] << 8 | x[near + 2]
            if len(self.three):
                three[near] = self.three[np.minimum(np.searchsorted(self.three, code), len(self.three) - 1)] == code
            cut[at + 1] = ~three[at] & ~(three[at - 1] & (at > 0))
        cut[start] = True
        bounds = np.flatnonzero(cut)
        return data, bounds, np.searchsorted(bounds, start)


def merge_by_queue(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one part, as the fold gives them, in time n log n: pairs wait in a queue by
    rank and place; a pair whose sides have changed meanwhile is passed over."""
    n = len(data)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by first byte of a symbol
    live = [True] * n

    def pair(at: int) -> tuple[int, int, int, int] | None:
        mid = end[at]
        rank = ranks.get(data[at : end[mid]]) if mid < n else None
        return None if rank is None else (rank, at, mid, end[mid])

    queue = [x for x in map(pair, range(n)) if x]
    heapq.heapify(queue)
    while queue:
        _, at, mid, to = heapq.heappop(queue)
        if not (live[at] and end[at] == mid and end[mid] == to):
            continue
        live[mid], end[at] = False, to
        if to < n:
            before[to] = at
        for x in (before[at], at):
            if x >= 0 and (found := pair(x)):
                heapq.heappush(queue, found)
    out, at = [], 0
    while at < n:
        out.append(ranks[data[at : end[at]]])
        at = end[at]
    return out


class Decoder:
    """Bytes of ids, all at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values(), default=0) + 1
        lengths = np.zeros(size, np.int64)
        for piece, i in ranks.items():
            lengths[i] = len(piece)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.empty(self.start[-1], np.uint8)
        for piece, i in ranks.items():
            self.data[self.start[i] : self.start[i + 1]] = np.frombuffer(piece, np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_gather(self.start, ids)]


def _gather(start: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the entries ``start[i]:start[i+1]`` for each i of ``which``, in order."""
    lo = start[which]
    n = start[which + 1] - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def _ends(start: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Before each i of ``which`` and after the last: how many positions :func:`_gather` gives up to there."""
    return np.concatenate([[0], np.cumsum(start[which + 1] - start[which], dtype=np.int64)])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, the bytes of ``values[ends[i]:ends[i + 1]]``."""
    offsets = ends * values.itemsize
    if offsets[-1] >= 1 << 31:
        return pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit integers of all binary values, and where each value begins and the last ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    own = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return np.frombuffer(own.tobytes(), np.int32), (offsets - offsets[0]) // 4


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], p: BpeParams = BpeParams()) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary)."""
    spark = docs.sparkSession
    ranks = read_ranks(path)
    shared = spark.sparkContext.broadcast(ranks)  # one vocabulary file
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // p.task_bytes))
    source = docs.select(*keep, F.col("text").alias("_text")).coalesce(tasks)  # joins neighbours, without a shuffle
    byte_number = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
    if (byte_number < 0).any():
        raise ValueError("a byte has no rank in " + path)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    width = len(keep)

    @gives_back
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        give_back()
        find, cuts = regex.compile(pattern).findall, Cuts(shared.value)
        #: pieces by number, and parts of cut pieces; a piece that isn't cut is a part that nothing else looks up
        numbers: dict[str, int] = {}
        known: dict[bytes, int] = {}
        #: parts of each piece, by its number
        flat, start = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        remembered = used = made = 0
        for batch in batches:
            text = batch.column(width)
            names = [*batch.schema.names[:-1], "_number", "_symbols", "_list"]
            for c in chunks(text, p.chunk_bytes):
                if remembered > p.distinct_bytes:
                    numbers.clear()
                    known.clear()
                    remembered = used = made = 0
                found = [find(t) if t else [] for t in text.slice(c.rows.start, c.n).to_pylist()]
                new = list(set().union(*found).difference(numbers))
                data, bounds, first = cuts.parts([x.encode() for x in new])
                remembered += len(data)
                n_parts, own = np.diff(first), np.empty(len(bounds) - 1, np.int32)
                whole = np.repeat(n_parts == 1, n_parts)
                at = np.flatnonzero(whole)
                own[at] = np.arange(made, made + len(at))
                begin, at, bounds = made, at.tolist(), bounds.tolist()
                made += len(at)
                for k in np.flatnonzero(~whole).tolist():
                    number = known.setdefault(data[bounds[k] : bounds[k + 1]], made)
                    if number == made:
                        made += 1
                        at.append(k)
                    own[k] = number
                fresh = [data[bounds[k] : bounds[k + 1]] for k in at]
                before = len(numbers)
                numbers.update(zip(new, range(before, before + len(new)), strict=True))
                flat, start = _room(flat, used + len(own)), _room(start, before + len(first))
                flat[used : used + len(own)] = own
                start[before : before + len(first)] = used + first
                used += len(own)
                edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
                which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, edge[-1])
                lists = _binary(flat[_gather(start, which)], _ends(start, which)[edge])
                del found, new, own, which, data, bounds, at
                kept = [batch.column(i).slice(c.rows.start, c.n) for i in range(width)]
                if fresh:
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.nulls(len(fresh), k.type) for k in kept), pa.array(np.arange(begin, made, dtype=np.int32)),
                            byte_symbols([x if len(x) <= p.fold_bytes else None for x in fresh], byte_number),
                            pa.array([x if len(x) > p.fold_bytes else None for x in fresh], pa.binary()),
                        ],
                        names=names,
                    )
                yield pa.RecordBatch.from_arrays([*kept, pa.nulls(c.n, pa.int32()), pa.nulls(c.n, pa.list_(pa.int32())), lists], names=names)
                del lists, kept, fresh

    @gives_back
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        decode = Decoder(shared.value)
        flat, start, used = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        for batch in batches:
            number, ids, lists = batch.column(width), batch.column(width + 1), batch.column(width + 2)
            # rows of pieces and rows of texts come in turns; each run is handled at once
            is_text = number.is_null().to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(is_text)) + 1, [len(is_text)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if not is_text[a]:
                    which = number.slice(a, b - a).to_numpy()
                    # a task that forgets its pieces starts again at number 0
                    for lo, hi in _restarts(which):
                        if which[lo] == 0:
                            used = 0
                        own_ids = _with_long(ids.slice(a + lo, hi - lo), lists.slice(a + lo, hi - lo), shared.value)
                        values, bounds = own_ids.flatten().to_numpy(), own_ids.offsets.to_numpy()
                        k, at = int(which[lo]), used
                        flat, start = _room(flat, at + len(values)), _room(start, k + hi - lo + 1)
                        flat[at : at + len(values)] = values
                        start[k : k + hi - lo + 1] = bounds - bounds[0] + at
                        used = at + len(values)
                    continue
                # a few rows at a time, so that no more than these are held beside the batch
                data, edge = _numbers(lists.slice(a, b - a))
                lo = 0
                while lo < b - a:
                    hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + p.joined_parts, side="right")) - 1)
                    which = data[edge[lo] : edge[hi]]
                    coded = flat[_gather(start, which)]
                    cut = _ends(start, which)[edge[lo : hi + 1] - edge[lo]]
                    kept = [batch.column(i).slice(a + lo, hi - lo) for i in range(width)]
                    plain = _binary(decode(coded), _ends(decode.start, coded)[cut])
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(np.diff(cut)), _binary(coded.astype("<u4"), cut), plain],
                        names=[*batch.schema.names[:width], "n_tokens", "ids", "decoded"],
                    )
                    lo = hi

    pieces = source.mapInArrow(split, f"{own}, _number int, _symbols array<int>, _list binary")
    ids = F.when(F.col("_symbols").isNotNull(), encode_part(F.col("_symbols"), F.col("_ranks")))
    # a higher-order function can't name a subquery itself; a column that is used once is evaluated where it is used
    coded = pieces.withColumn("_ranks", tables(spark, PairRanks.of(ranks))).select(*keep, "_number", ids.alias("_ids"), "_list")
    return coded.mapInArrow(join, f"{own}, n_tokens long, ids binary, decoded binary")


def _with_long(ids: pa.Array, data: pa.Array, ranks: dict[bytes, int]) -> pa.Array:
    """The fold's ids, and those of the parts that were too long for it."""
    if not ids.null_count:
        return ids
    return pa.array([merge_by_queue(d, ranks) if d is not None else x for x, d in zip(ids.to_pylist(), data.to_pylist(), strict=True)], pa.list_(pa.int32()))


def _restarts(numbers: np.ndarray) -> list[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(np.diff(numbers) != 1) + 1).tolist(), len(numbers)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) >= n:
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out
