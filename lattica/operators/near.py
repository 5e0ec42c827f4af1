"""Pairs of rows that differ in few sites, counted for each row.

Codes are held as bit planes, so the sites in which two rows differ are the ones of a word: ``xor`` of each plane, ``or`` of
them, and a count of bits. Pairs are met in one of two ways, both exact:

* by keys: sites are cut into d + k segments, d the sites in which near rows may differ, so near rows agree in k segments at
  least. Each choice of k segments and their codes is a key; rows are shuffled and sorted by key and rows of one key meet. A pair
  counts at the key of the first k segments in which it agrees. Choices of segments are taken in rounds, and what a round has
  shuffled goes before the next one, so the disk holds a round of keys whatever their number.
* all with all, of given groups.

Rows of a key or group are cut into chunks of bounded size; two chunks are a row of a join, so many tasks share a large one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.stored import Stored, release

#: Rows of a chunk; rows that are sorted by key are met so many at a time.
CHUNK_ROWS, STEP_ROWS = 4096, 1 << 16
#: Rows of a chunk of a key: each pair of chunks is shuffled, so there are fewer of them.
KEY_ROWS = 1 << 14
#: Rows of all keys of a round, which has one choice of segments at least.
ROUND_ROWS = 8_000_000
#: Rows of a key up to which pairs are made by distance in the sorted order.
SHORT = 48
#: Rows on which the number of segments is chosen; results don't depend on them.
TRIAL_ROWS = 4096
#: Nanoseconds of a pair of one key, of a pair of all with all, and of a row of a key, by which the choice is made.
PAIR_COST, ALL_COST, ROW_COST = 15, 2, 1500
#: Keys of a row at most.
MOST_KEYS = 256


@dataclass(frozen=True)
class Shape:
    """Codes from ``low``, ``bits`` planes of them, and the sites in which near rows may differ."""

    sites: int
    low: int
    bits: int
    apart: int

    @classmethod
    def of(cls, sites: int, low: int, high: int, apart: int) -> Shape:
        return cls(sites, low, max(1, (high - low).bit_length()), min(apart, sites))

    @property
    def wide(self) -> bool:
        return self.sites > 32

    @property
    def words(self) -> int:
        return -(-self.sites // 64) if self.wide else 1

    @property
    def names(self) -> list[str]:
        return [f"w{i}" for i in range(self.bits * self.words if self.wide else -(-self.bits // 2))]

    @property
    def schema(self) -> str:
        return ", ".join(f"{x} long" for x in self.names)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """(columns, rows) of (rows, sites); up to 32 sites two planes share a column."""
        n, kind = len(codes), np.uint64 if self.wide else np.uint32
        shifted = codes.astype(np.int64) - self.low
        if shifted.size and (shifted.min() < 0 or shifted.max() >> self.bits):
            raise ValueError(f"codes from {codes.min()} to {codes.max()} don't fit {self.bits} bits from {self.low}")
        planes = np.zeros((self.bits + (not self.wide and self.bits % 2), self.words, n), kind)
        for p in range(self.bits):
            bit = np.zeros((n, 64 * self.words if self.wide else 32), np.uint8)
            bit[:, : self.sites] = shifted >> p & 1
            planes[p] = np.packbits(bit, axis=1, bitorder="little").view(kind).T
        if self.wide:
            return planes.reshape(-1, n)
        return planes[0::2, 0].astype(np.uint64) | planes[1::2, 0].astype(np.uint64) << np.uint64(32)

    def planes(self, columns: np.ndarray) -> np.ndarray:
        """(bits, words, rows) of packed columns."""
        if self.wide:
            return columns.reshape(self.bits, self.words, -1)
        out = np.empty((2 * len(columns), columns.shape[1]), np.uint32)
        out[0::2], out[1::2] = columns & np.uint64(0xFFFFFFFF), columns >> np.uint64(32)
        return out[: self.bits, None]

    def masks(self, mask: int) -> list[int]:
        """A mask of sites for each packed column."""
        if not self.wide:
            return [mask | mask << 32] * len(self.names)
        return [mask >> 64 * w & (1 << 64) - 1 for w in range(self.words)] * self.bits


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(words, ...) with ones where the codes of x and y differ."""
    out = x[0] ^ y[0]
    for p in range(1, len(x)):
        out |= x[p] ^ y[p]
    return out


def ones(words: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(words)
    return n[0] if len(n) == 1 else n.sum(axis=0, dtype=np.uint16)


@dataclass
class Rows:
    """Planes of rows, how many copies each has, and the choice of segments under which it is met."""

    planes: np.ndarray
    copies: np.ndarray
    choice: np.ndarray

    def part(self, at) -> Rows:
        return Rows(self.planes[:, :, at], self.copies[at], self.choice[at])

    @property
    def n(self) -> int:
        return len(self.copies)


@dataclass(frozen=True)
class Near:
    """Which pairs are near and count here; without segments (k 0) all near pairs count."""

    shape: Shape
    k: int = 0

    @functools.cached_property
    def segments(self) -> list[int]:
        """Masks of sites."""
        cuts = np.linspace(0, self.shape.sites, self.shape.apart + self.k + 1).astype(int).tolist() if self.k else [0]
        return [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @functools.cached_property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(len(self.segments)), self.k))

    @functools.cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segments, words) masks, and which segments must agree and which must not, by choice."""
        kind = np.uint64 if self.shape.wide else np.uint32
        size = 64 if self.shape.wide else 32
        masks = np.array([[m >> size * w & (1 << size) - 1 for w in range(self.shape.words)] for m in self.segments], kind)
        inside = np.zeros((len(self.choices), len(self.segments)), bool)
        before = np.zeros_like(inside)
        for c, chosen in enumerate(self.choices):
            inside[c, list(chosen)] = True
            before[c, : chosen[-1]] = True
        return masks, inside, before & ~inside

    def first(self, differ: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Whether the choice is of the first k segments in which a pair agrees."""
        masks, inside, before = self._tables
        out = np.ones(len(choice), bool)
        for j, mask in enumerate(masks):
            agree = ~(differ & mask[:, None]).any(axis=0)
            out &= ~np.where(agree, before[choice, j], inside[choice, j])
        return out

    def near(self, differ: np.ndarray) -> np.ndarray:
        return ones(differ) <= self.shape.apart

    def meet(self, x: Rows, y: Rows, nx: np.ndarray, ny: np.ndarray, same: bool) -> None:
        """Add to nx and ny the copies of near rows on the other side; ``same``: x is y, and each two rows meet once."""
        for a in range(0, x.n, 64):
            own = x.part(slice(a, a + 64))
            for b in range(a if same else 0, y.n, 2048):
                other = y.part(slice(b, b + 2048))
                differ = differing(own.planes[:, :, :, None], other.planes[:, :, None, :])
                near = self.near(differ)
                if same and b < a + own.n:
                    near &= np.arange(b, b + other.n)[None] > np.arange(a, a + own.n)[:, None]
                hits = np.count_nonzero(near)
                if not hits:
                    continue
                c = own.choice[0]
                if self.k and hits * 16 >= near.size and (own.choice == c).all() and (other.choice == c).all():
                    masks, inside, before = self._tables
                    for j, mask in enumerate(masks):
                        if before[c, j]:
                            near &= (differ & mask[:, None, None]).any(axis=0)
                        elif inside[c, j]:
                            near &= ~(differ & mask[:, None, None]).any(axis=0)
                elif self.k or hits * 16 < near.size:
                    i, j = np.divmod(np.flatnonzero(near), other.n)
                    if self.k:
                        kept = self.first(differ[:, i, j], own.choice[i]) & (own.choice[i] == other.choice[j])
                        i, j = i[kept], j[kept]
                    nx[a : a + own.n] += np.bincount(i, other.copies[j], own.n).astype(np.int64)
                    ny[b : b + other.n] += np.bincount(j, own.copies[i], other.n).astype(np.int64)
                    continue
                dense = near.astype(np.float64)
                nx[a : a + own.n] += (dense @ other.copies).astype(np.int64)
                ny[b : b + other.n] += (own.copies @ dense).astype(np.int64)

    def meet_runs(self, rows: Rows, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Near rows of each row among those of its run; runs follow each other, ``size`` and ``place`` are those of each row."""
        n = np.zeros(rows.n, np.int64)
        for at in np.flatnonzero((place == 0) & (size > SHORT)):
            run = slice(at, at + size[at])
            part = rows.part(run)
            self.meet(part, part, n[run], n[run], True)
        left = np.where(size > SHORT, 0, size - place - 1)
        active, step = np.flatnonzero(left > 0), 1
        while len(active):
            for at in range(0, len(active), STEP_ROWS):
                i = active[at : at + STEP_ROWS]
                j = i + step
                differ = differing(rows.planes[:, :, i], rows.planes[:, :, j])
                near = np.flatnonzero(self.near(differ))
                i, j = i[near], j[near]
                if self.k:
                    kept = self.first(differ[:, near], rows.choice[i]) & (rows.choice[i] == rows.choice[j])
                    i, j = i[kept], j[kept]
                n[i] += rows.copies[j]
                n[j] += rows.copies[i]
            active, step = active[left[active] > step], step + 1
        return n

    def rows(self, columns: np.ndarray) -> Rows:
        """Of packed columns, copies and choices, all as 64 bits."""
        return Rows(self.shape.planes(columns[:-2]), columns[-2].view(np.int64), columns[-1].view(np.int64))


def packed(rows: DataFrame, shape: Shape, *keep: str) -> DataFrame:
    """``keep`` columns of ``rows`` and the packed columns of its codes."""
    source = rows.select(*keep, "codes")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(len(keep))
            found = shape.pack(codes.flatten().to_numpy().reshape(len(codes), shape.sites))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found.view(np.int64))], names=[*keep, *shape.names])

    return source.mapInArrow(run, f"{kept}, {shape.schema}" if keep else shape.schema)


def distinct(rows: DataFrame, shape: Shape, *by: str) -> DataFrame:
    return rows.groupBy(*by, *shape.names).agg(F.count(F.lit(1)).alias("copies"))


def choose(rows: DataFrame, n: int, shape: Shape, least: int = 0) -> int:
    """How many segments agree in a key, ``least`` at least, 0 for all with all: whichever is likely to cost least. Without a
    segment that has to agree it is 0."""
    if n <= TRIAL_ROWS or shape.apart >= shape.sites:
        return min(least, shape.sites - shape.apart)
    some = rows.orderBy(F.xxhash64(*shape.names)).limit(TRIAL_ROWS).select(*shape.names).toArrow()
    columns = np.stack([c.to_numpy() for c in some.columns]).view(np.uint64)
    costs = {} if least else {0: n * n / 2 * ALL_COST}
    for k in range(max(1, least), min(4, shape.sites - shape.apart + 1)):
        near = Near(shape, k)
        if len(near.choices) > MOST_KEYS and costs:
            break
        alike = 0
        for chosen in near.choices:
            mask = np.array(shape.masks(sum(near.segments[j] for j in chosen)), np.uint64)
            counts = np.unique(columns & mask[:, None], axis=1, return_counts=True)[1].astype(np.int64)
            alike += int((counts * (counts - 1)).sum())
        costs[k] = n * n / 2 * alike / max(1, columns.shape[1] * (columns.shape[1] - 1)) * PAIR_COST + n * len(near.choices) * ROW_COST
    return min(costs, key=costs.get)


def by_keys(rows: DataFrame, n: int, near: Near, most: int = KEY_ROWS) -> DataFrame:
    """(packed columns, n): near rows of ``n`` distinct ``rows`` (packed columns, copies), their own copies included. ``rows`` are
    read once for each round."""
    names, spark = near.shape.names, rows.sparkSession
    per = max(1, ROUND_ROWS // max(1, n))
    held: list[Stored] = []
    size = 0  # rows held

    def summed(parts: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.union, parts).groupBy(*names).agg(F.sum("n").alias("n"))

    for at in range(0, len(near.choices), per):
        held.append(_round(rows, n, near, range(len(near.choices))[at : at + per], most))
        size += held[-1].df.count()
        if size > n and len(held) > 1:
            before, held = held, [Stored(summed([x.df.select(*names, "n") for x in held]), "near")]
            size = held[0].df.count()
            for x in before:
                x.drop()
        if per < len(near.choices):
            release(spark)
    return summed([rows.select(*names, F.col("copies").alias("n")), *(x.df.select(*names, "n") for x in held)])


def _round(rows: DataFrame, n: int, near: Near, some: range, most: int) -> Stored:
    """(packed columns, n) of rows that have near ones by some of the choices; a row may be there several times."""
    shape, spark = near.shape, rows.sparkSession
    signed = [
        (c, *[m - (1 << 64) if m >> 63 else m for m in shape.masks(sum(near.segments[j] for j in near.choices[c]))]) for c in some
    ]
    if len(signed) == 1:
        (c, *masks), chosen = signed[0], rows
        masked = [F.col(x).bitwiseAND(F.lit(m)) for x, m in zip(shape.names, masks, strict=True)]
        choice = F.lit(c).cast("long").alias("choice")
    else:
        choices = spark.createDataFrame(signed, "choice long, " + ", ".join(f"m_{x} long" for x in shape.names))
        masked, chosen, choice = [F.col(x).bitwiseAND(F.col(f"m_{x}")) for x in shape.names], rows.crossJoin(F.broadcast(choices)), F.col("choice")
    keyed = chosen.select(F.xxhash64(choice, *masked).alias("key"), *shape.names, "copies", choice)
    parts = max(spark.sparkContext.defaultParallelism, -(-n * len(some) // 1_500_000))
    met = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_runs(near, most), f"{shape.schema}, n long, {_CHUNK}")
    stored = Stored(met, "near")
    chunks = stored.df.where(F.col("rows").isNotNull()).select("key", "part", "chunk", "rows")
    if chunks.select("key").isEmpty():
        return stored
    found = stored.df.where(F.col("rows").isNull()).select(*shape.names, "n")
    a, b = (chunks.select("key", F.col("chunk").alias(x)) for x in ("x", "y"))
    pairs = a.join(b, "key").where("x < y").select("key", F.lit(0).alias("px"), "x", F.col("key").alias("other"), F.lit(0).alias("py"), "y")
    found = found.union(_meet_chunks(chunks, pairs, near).drop("key"))
    out = Stored(found.groupBy(*shape.names).agg(F.sum("n").alias("n")), "near")
    stored.drop()
    return out


_CHUNK = "key long, part int, chunk int, rows binary"


def _runs(near: Near, most: int):
    """Rows sorted by key: counts of rows that have near ones in their key, and the chunks of keys of more rows than ``most``."""
    width = len(near.shape.names)

    def finish(key: np.ndarray, columns: np.ndarray, size: np.ndarray, place: np.ndarray, chunk: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = near.rows(columns)
        n = near.meet_runs(rows, size, place)
        at = np.flatnonzero(n)
        if len(at):
            none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
            yield _batch(near, columns[:width, at], n[at], none)
        for at in np.flatnonzero((place == 0) & ((chunk > 0) | (size == most))):
            one = [pa.array([key[at]]), pa.array([0], pa.int32()), pa.array([chunk[at]], pa.int32()), pa.array([columns[:, at : at + size[at]].tobytes()])]
            yield _batch(near, None, None, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting, last, before = 0, None, 0  # rows held, the last key, and how many of its rows were met earlier
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(np.stack([c.to_numpy() for c in batch.columns]))
                waiting += batch.num_rows
                if waiting < STEP_ROWS:
                    continue
            if not waiting:
                continue
            table = np.concatenate(held, axis=1)
            key, columns = table[0], table[1:].view(np.uint64)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
            if key[0] == last:
                rank[: start[1] if len(start) > 1 else len(key)] += before
            chunk, place = rank // most, rank % most
            # a chunk begins where a key or its part begins
            begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] == 0)))
            ends = np.append(begins[1:], len(key))
            place = np.arange(len(key)) - np.repeat(begins, ends - begins)
            size = np.repeat(ends - begins, ends - begins)
            end = len(key)
            if batch is not None and ends[-1] - begins[-1] < most:
                end = begins[-1]  # its chunk may go on
            yield from finish(key[:end], columns[:, :end], size[:end], place[:end], chunk[:end])
            last, before = key[-1], int(rank[-1]) + 1 - (len(key) - end)
            held, waiting = [table[:, end:]], len(key) - end

    return run


def _batch(near: Near, columns, n, chunk: list) -> pa.RecordBatch:
    if columns is None:
        own = [pa.nulls(1, pa.int64()) for _ in range(len(near.shape.names) + 1)]
    else:
        own = [*map(pa.array, np.ascontiguousarray(columns).view(np.int64)), pa.array(n)]
    return pa.RecordBatch.from_arrays([*own, *chunk], names=[*near.shape.names, "n", "key", "part", "chunk", "rows"])


def _meet_chunks(chunks: DataFrame, pairs: DataFrame, near: Near) -> DataFrame:
    """(key, packed columns, n) of the chunks of ``pairs`` (key, px, x, other, py, y); a chunk with itself is met once."""
    x = chunks.select("key", F.col("part").alias("px"), F.col("chunk").alias("x"), F.col("rows").alias("left"))
    y = chunks.select(F.col("key").alias("other"), F.col("part").alias("py"), F.col("chunk").alias("y"), F.col("rows").alias("right"))
    both = pairs.join(x, ["key", "px", "x"]).join(y, ["other", "py", "y"])
    same = (F.col("key") == F.col("other")) & (F.col("px") == F.col("py")) & (F.col("x") == F.col("y"))
    parts = 4 * chunks.sparkSession.sparkContext.defaultParallelism
    names = near.shape.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, key, other, one in zip(*batch.columns, strict=True):
                tables = [np.frombuffer(b.as_buffer(), np.uint64).reshape(len(names) + 2, -1) for b in (left, right)]
                a, b = map(near.rows, tables)
                na = np.zeros(a.n, np.int64)
                nb = na if one.as_py() else np.zeros(b.n, np.int64)
                near.meet(a, b, na, nb, one.as_py())
                for table, n, of in [(tables[0], na, key), (tables[1], nb, other)][: 1 if one.as_py() else 2]:
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), of.as_py())), *map(pa.array, np.ascontiguousarray(table[:-2, at]).view(np.int64)), pa.array(n[at])],
                        names=["key", *names, "n"])

    dealt = both.select("left", "right", "key", "other", same.alias("one"), F.xxhash64("key", "px", "x", "other", "py", "y").alias("at"))
    dealt = dealt.repartition(parts, "at").select("left", "right", "key", "other", "one")
    return dealt.mapInArrow(run, f"key long, {near.shape.schema}, n long")


def all_with_all(rows: DataFrame, n: int, shape: Shape, groups: DataFrame, most: int = CHUNK_ROWS) -> DataFrame:
    """(key, packed columns, n): near rows of ``n`` distinct ``rows`` (key, packed columns, copies) among those of the keys that
    ``groups`` (key, other) puts beside theirs, in either order; their own copies are included."""
    near = Near(shape)
    buckets = max(1, -(-n // most))
    cut = rows.select("key", *shape.names, "copies", F.lit(0).cast("long").alias("choice"))
    cut = cut.repartition(buckets, F.pmod(F.xxhash64(*shape.names), F.lit(buckets))).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            table = np.stack([c.to_numpy() for c in batch.columns])
            starts = np.append(np.flatnonzero(np.append(True, table[0, 1:] != table[0, :-1])), table.shape[1]).tolist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                for at in range(a, b, most):
                    piece = table[1:, at : min(b, at + most)].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([table[0, a]]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([piece])],
                        names=["key", "part", "chunk", "rows"])
                    number += 1

    chunks = Stored(cut.mapInArrow(run, _CHUNK), "chunks").df
    a = chunks.select("key", F.col("part").alias("px"), F.col("chunk").alias("x"))
    b = chunks.select(F.col("key").alias("other"), F.col("part").alias("py"), F.col("chunk").alias("y"))
    allowed = groups.select(F.least("key", "other").cast("long").alias("key"), F.greatest("key", "other").cast("long").alias("other")).distinct()
    pairs = a.join(F.broadcast(allowed), "key").join(b, "other").where(
        (F.col("key") != F.col("other")) | (F.struct("px", "x") <= F.struct("py", "y")))
    found = _meet_chunks(chunks, pairs, near)
    return found.union(rows.select("key", *shape.names, "copies")).groupBy("key", *shape.names).agg(F.sum("n").alias("n"))


def by_broadcast(rows: DataFrame, shape: Shape) -> DataFrame:
    """(packed columns, n): near rows of distinct ``rows`` (packed columns, copies) that may be broadcast, their own copies included."""
    table, near, names = rows.select(*shape.names, "copies").toArrow(), Near(shape), shape.names
    columns = np.stack([c.to_numpy() for c in table.columns]) if table.num_rows else np.empty((len(names) + 1, 0), np.int64)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(columns)
    size = 512
    blocks = math.ceil(columns.shape[1] / size)
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        copies = whole[-1]
        every = Rows(shape.planes(whole[:-1].view(np.uint64)), copies, np.zeros_like(copies))
        n = np.zeros(len(copies), np.int64)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                own, rest = slice(at * size, (at + 1) * size), slice((at + 1) * size, None)
                x = every.part(own)
                near.meet(x, x, n[own], n[own], True)
                near.meet(x, every.part(rest), n[own], n[rest], False)
                n[own] += copies[own]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([*map(pa.array, np.ascontiguousarray(whole[:-1, at])), pa.array(n[at])], names=[*names, "n"])

    # early blocks meet more rows than late ones, so blocks are dealt in turn
    dealt = spark.range(0, blocks, 1, 1).repartition(parts) if blocks else spark.range(0)
    return dealt.mapInArrow(run, f"{shape.schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))
