"""Row weights by inverse neighbourhood size.

Two rows are neighbours if at least (1 - theta) of their sites agree, gaps included.
Equal rows are collapsed first and counted with their multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.alphabet import matches
from lattica.operators import near
from lattica.sources.stored import Stored, kept

#: Bytes of packed distinct rows that may be broadcast.
BROADCAST_BYTES = 64 << 20


def least_matches(theta: float, n_sites: int) -> int:
    """Fewest agreeing sites of neighbours; the product is taken in double, as given."""
    return math.ceil((1 - theta) * n_sites)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(codes, copies): partial aggregation leaves one row for each distinct vector."""
    return rows.groupBy("codes").agg(F.count(F.lit(1)).alias("copies"))


def most_apart(theta: float, n_sites: int) -> int:
    """Most sites in which neighbours differ."""
    return n_sites - min(n_sites, max(0, least_matches(theta, n_sites)))


def neighbor_counts(rows: DataFrame, theta: float, q: int, strategy: str = "auto") -> DataFrame:
    """(s, n): neighbours of each row, itself included.

    ``block`` compares all distinct rows with all, ``segments`` those that agree in some segments of sites
    (:mod:`lattica.operators.near`), ``join`` is the second one as a plain join. All are exact; what is likely to be done
    sooner is taken where none is named."""
    first = rows.select(F.size("codes").alias("sites")).first()
    n_sites = first.sites if first else 0
    if strategy == "join":
        counted = _joined(distinct_rows(rows).cache(), theta, n_sites)
        return rows.join(counted, "codes").select("s", "n")
    shape = near.Shape.of(n_sites, -1, q - 1, most_apart(theta, n_sites))
    packed = kept(near.packed(rows, shape, "s"), "packed")
    distinct = kept(near.distinct(packed, shape), "distinct")
    counted = _counted(distinct, distinct.count(), shape, strategy)
    return packed.join(counted, shape.names).select("s", "n")


def _counted(distinct: DataFrame, n: int, shape: near.Shape, strategy: str, most: int | None = None) -> DataFrame:
    """(packed columns, n) of ``n`` distinct rows."""
    if strategy == "segments":
        k = near.choose(distinct, n, shape, least=1)
    else:
        k = near.choose(distinct, n, shape) if strategy == "auto" else 0
    if k:
        return near.by_keys(distinct, n, near.Near(shape, k), most or near.KEY_ROWS)
    if n * 8 * (len(shape.names) + 1) <= BROADCAST_BYTES:
        return near.by_broadcast(distinct, shape)
    one = distinct.sparkSession.createDataFrame([(0, 0)], "key long, other long")
    return near.all_with_all(distinct.withColumn("key", F.lit(0).cast("long")), n, shape, one, most or near.CHUNK_ROWS).drop("key")


def _segments(distinct: DataFrame, theta: float, n_sites: int, most: int = near.CHUNK_ROWS) -> DataFrame:
    """(codes, n) of distinct rows (codes, copies) by segments."""
    bounds = distinct.agg(F.min(F.array_min("codes")), F.max(F.array_max("codes")), F.count(F.lit(1))).first()
    shape = near.Shape.of(n_sites, bounds[0] or 0, bounds[1] or 0, most_apart(theta, n_sites))
    packed = near.packed(distinct, shape, "codes", "copies")
    return packed.join(_counted(packed.drop("codes"), bounds[2], shape, "segments", most), shape.names).select("codes", "n")


def _matrix(column, n_sites: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), n_sites) if len(column) else np.empty((0, n_sites), np.int32)


def one_hot(codes: np.ndarray, q: int, kind=np.float64) -> np.ndarray:
    """(rows, sites * q); negative codes give zeros."""
    n, sites = codes.shape
    out = np.zeros((n, sites * q), kind)
    rows, cols = np.nonzero(codes >= 0)
    out[rows, cols * q + codes[rows, cols]] = 1
    return out


#: Rows with one join key; a key of more is split further.
KEY_ROWS = 4096
#: Keys of more rows that may be broadcast.
BROADCAST_KEYS = 1 << 20


def _joined(distinct: DataFrame, theta: float, n_sites: int, most: int = KEY_ROWS) -> DataFrame:
    """With at most d disagreeing sites one of d + 1 segments agrees: join on segments, keep a pair where it first
    agrees, then compare whole rows."""
    close = matches(F.col("x"), F.col("y")) >= F.lit(float((1 - theta) * n_sites))
    found = None
    for left, right, first in segment_joins(distinct, theta, n_sites, most):
        met = left.join(right, "key").where(first & close).select("x", "copies")
        found = met if found is None else found.union(met)
    return found.groupBy(F.col("x").alias("codes")).agg(F.sum("copies").alias("n"))


def segment_joins(distinct: DataFrame, theta: float, n_sites: int, most: int = KEY_ROWS) -> list[tuple[DataFrame, DataFrame, Column]]:
    """(left, right, condition) of the joins on ``key`` that meet each near pair of rows x and y once.

    Keys are segments. Rows of a segment that more than ``most`` rows share differ in the other sites, at most d of
    them, so these are cut into d + 1 segments in turn. Rows that share both are dealt to blocks, and each two
    blocks are a key: no key has many more rows than ``most``."""
    d = max(0, n_sites - max(0, least_matches(theta, n_sites)))
    cuts = np.linspace(0, n_sites, min(d + 1, max(1, n_sites)) + 1).astype(int)
    spans = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if d >= n_sites:  # theta so large that no segment need agree
        spans = [(0, 0)]
    key = F.array(*[F.struct(F.lit(k).alias("k"), F.slice("codes", a + 1, b - a).alias("part")) for k, (a, b) in enumerate(spans)])
    cut = distinct.select("codes", "copies", F.explode(key).alias("key"))
    plain, crowded = _parted(cut, most)
    earlier = [F.when((F.col("at") > k) & (F.slice("x", a + 1, b - a) == F.slice("y", a + 1, b - a)), True) for k, (a, b) in enumerate(spans)]
    first = F.coalesce(*earlier, F.lit(False)) == F.lit(False)
    out = [(*_sides(plain, F.col("key.k")), first)]
    if crowded is None:
        return out
    # the other sites of crowded segments, and their segments
    lo = F.element_at(F.array(*[F.lit(a) for a, _ in spans]), F.col("key.k") + 1)
    hi = F.element_at(F.array(*[F.lit(b) for _, b in spans]), F.col("key.k") + 1)
    rest = F.concat(F.slice("codes", F.lit(1), lo), F.slice("codes", hi + 1, F.lit(n_sites)))
    pieces = d + 1

    def piece(sites: Column, j: Column) -> Column:
        start = F.floor(j * F.size(sites) / pieces).cast("int")
        return F.slice(sites, start + 1, F.floor((j + 1) * F.size(sites) / pieces).cast("int") - start)

    inner = F.transform(F.sequence(F.lit(0), F.lit(d)), lambda j: F.struct(j.alias("j"), piece(F.col("rest"), j).alias("piece")))
    again = crowded.withColumn("rest", rest).select("codes", "copies", "rest", F.col("key").alias("outer"), F.explode(inner).alias("inner"))
    again = again.select("codes", "copies", "rest", F.struct("outer", "inner").alias("key"))
    plain, crowded = _parted(again, most)
    earlier_inside = F.exists(
        F.sequence(F.lit(0), F.lit(d)), lambda j: (j < F.col("inside")) & (piece(F.col("x_rest"), j) == piece(F.col("y_rest"), j)))
    once = first & ~earlier_inside
    place = F.col("key.outer.k"), F.col("key.inner.j")
    out.append((*_sides(plain, *place), once))
    if crowded is not None:
        block = F.pmod(F.xxhash64("codes"), F.col("blocks"))
        own = crowded.withColumn("blocks", (F.ceil(F.col("n") / most) * 2).cast("long")).withColumn("own", block)
        left = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = left.withColumn("key", F.struct("key", F.col("other").alias("l"), F.col("own").alias("r")))
        left = left.withColumn("key", F.struct("key", F.col("own").alias("l"), F.col("other").alias("r")))
        place = F.col("key.key.outer.k"), F.col("key.key.inner.j")
        out.append((_sides(left, *place)[0], _sides(right, *place)[1], once))
    return out


def _parted(cut: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key at most ``most`` rows share, and the others (None if there are none) with n, how many do."""
    crowded = cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).cache()
    many = crowded.limit(BROADCAST_KEYS + 1).count()
    if not many:
        return cut, None
    keys = F.broadcast(crowded) if many <= BROADCAST_KEYS else crowded
    return cut.join(keys.select("key"), "key", "left_anti"), cut.join(keys, "key")


def _sides(rows: DataFrame, at: Column, inside: Column | None = None) -> tuple[DataFrame, DataFrame]:
    extra = [] if inside is None else [inside.alias("inside"), F.col("rest").alias("x_rest")]
    left = rows.select("key", F.col("codes").alias("x"), at.alias("at"), *extra)
    right = rows.select("key", F.col("codes").alias("y"), "copies", *([] if inside is None else [F.col("rest").alias("y_rest")]))
    return left, right


def sequence_weights(rows: DataFrame, theta: float, q: int, scale: float = 1.0, strategy: str = "auto") -> DataFrame:
    """(s, w): scale over the neighbourhood size; theta outside [0, 1] gives every row the scale."""
    if not 0 <= theta <= 1:
        return rows.select("s", F.lit(float(scale)).alias("w"))
    return neighbor_counts(rows, theta, q, strategy).select("s", (F.lit(float(scale)) / F.col("n")).alias("w"))


def effective_count(weights: DataFrame) -> float:
    return weights.agg(F.sum("w")).first()[0] or 0.0


# Clustered approximation ---------------------------------------------------------------


def assign_clusters(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """``rows`` (s, codes, perhaps was) with cluster: the centre with most agreeing sites; a row's present cluster ``was``
    wins ties, then the least cluster. ``centers`` (cluster, center) has a fixed number of rows; they are
    broadcast, and rows meet them in place."""
    found = sorted((r.cluster, r.center) for r in centers.collect())
    shared = rows.sparkSession.sparkContext.broadcast((np.array([c for c, _ in found], np.int32), np.array([x for _, x in found], np.int64)))
    keep = [c for c in rows.columns if c != "was"]
    present = F.col("was") if "was" in rows.columns else F.lit(None)
    source = rows.select(*keep, present.cast("int").alias("_was"))
    codes_at = keep.index("codes")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, center = shared.value
        q = int(center.max(initial=0)) + 1
        hot = one_hot(center, q, np.float32)
        for batch in batches:
            codes = _matrix(batch.column(codes_at), center.shape[1]).astype(np.int64)
            was = batch.column(len(keep)).fill_null(-1).to_numpy()
            best = np.empty(len(codes), np.int32)
            for at in range(0, len(codes), 4096):
                own = codes[at : at + 4096]
                # a code that no centre has agrees with none of them
                agree = one_hot(np.where(own < q, own, -1), q, np.float32) @ hot.T
                agree = 2 * agree + (numbers[None] == was[at : at + 4096, None])
                best[at : at + 4096] = numbers[agree.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best)], names=[*keep, "cluster"])

    return source.mapInArrow(run, f"{schema}, cluster int")


def consensus(assigned: DataFrame) -> DataFrame:
    """(cluster, i, a, n): the most frequent code of each site, ties to the least code."""
    long = assigned.select("cluster", F.posexplode("codes").alias("at", "a"))
    counts = long.groupBy("cluster", (F.col("at") + 1).alias("i"), "a").count()
    return counts.groupBy("cluster", "i").agg(
        F.max_by("a", F.struct(F.col("count"), -F.col("a"))).alias("a"), F.max("count").alias("n"))


def as_centers(found: DataFrame) -> DataFrame:
    return found.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("center"))


def clustered_counts(assigned: DataFrame, centers: DataFrame, theta: float, n_sites: int, slack: float = 0.9) -> DataFrame:
    """(s, n): neighbours within cluster pairs whose centres agree in ``slack`` of the needed sites."""
    least = float((1 - theta) * n_sites)
    x = centers.select(F.col("cluster").cast("long").alias("key"), F.col("center").alias("u"))
    y = centers.select(F.col("cluster").cast("long").alias("other"), F.col("center").alias("v"))
    groups = x.join(y, matches(F.col("u"), F.col("v")) >= F.lit(slack * least)).select("key", "other")
    bounds = assigned.agg(F.min(F.array_min("codes")), F.max(F.array_max("codes"))).first()
    shape = near.Shape.of(n_sites, bounds[0] or 0, bounds[1] or 0, most_apart(theta, n_sites))
    packed = near.packed(assigned.select("s", F.col("cluster").cast("long").alias("key"), "codes"), shape, "s", "key").cache()
    distinct = near.distinct(packed, shape, "key").cache()
    counted = near.all_with_all(distinct, distinct.count(), shape, groups)
    return packed.join(counted, ["key", *shape.names]).select("s", "n")


def reservoir(n: int, k: int, seed: int, compat: bool) -> list[int]:
    """k of n row numbers by reservoir sampling from one stream of numbers, row by row; ``compat`` draws from one number too few."""
    raw = np.random.MT19937()
    raw._legacy_seeding(seed)
    kept = list(range(min(k, n)))
    for i in range(k, n):
        at = int(raw.random_raw()) % (i if compat else i + 1)
        if at < k:
            kept[at] = i
    return kept


def sample_rows(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(cluster, codes): k rows by priority: those whose keys have the least hashes. Each partition keeps its own k at most,
    so partitions merge in any order and the rows' order doesn't matter."""
    picked = rows.select("s", "codes").orderBy(F.xxhash64("s", F.lit(seed)), "s").limit(k).collect()
    return rows.sparkSession.createDataFrame([(c, list(r.codes)) for c, r in enumerate(picked)], "cluster int, center array<int>")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, their place by s from 0: places inside range partitions, and the sizes of those before."""
    kept = rows.columns
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))], names=[*kept, "_part", "_row"])
            row += n

    placed = Stored(rows.repartitionByRange("s").sortWithinPartitions("s").mapInArrow(run, f"{sql}, _part int, _row long"), "numbered").df
    before, start = {}, 0
    for r in sorted(placed.groupBy("_part").count().collect()):
        before[r["_part"]] = start
        start += r["count"]
    base = rows.sparkSession.createDataFrame(sorted(before.items()), "_part int, _base long")
    return placed.join(F.broadcast(base), "_part").select(*kept, (F.col("_row") + F.col("_base")).alias("at"))


def clustered_weights(rows: DataFrame, theta: float, k: int, scale: float = 1.0, rounds: int = 10, seed: int = 42, compat: bool = False) -> DataFrame:
    """(s, w) by k-consensus clustering. Only the k centres reach the driver; with k rows or
    fewer the exact counts are used. ``compat`` starts from the rows that the reference's stream of numbers picks,
    which is drawn row by row; else rows are picked by priority."""
    n = rows.count()
    if n <= k:
        q = (rows.agg(F.max(F.array_max("codes"))).first()[0] or 0) + 1
        return sequence_weights(rows, theta, q, scale)
    if compat:
        picked = rows.sparkSession.createDataFrame([(c, int(r)) for c, r in enumerate(reservoir(n, k, seed, True))], "cluster int, at long")
        centers = _fixed(numbered(rows).join(F.broadcast(picked), "at").select("cluster", F.col("codes").alias("center")))
    else:
        centers = sample_rows(rows, k, seed)
    assigned = Stored(assign_clusters(rows.select("s", "codes"), centers), "clusters")
    for _ in range(rounds - 1):
        # an empty cluster keeps its centre
        new = as_centers(consensus(assigned.df)).withColumnRenamed("center", "new")
        centers = _fixed(centers.join(new, "cluster", "left").select("cluster", F.coalesce("new", "center").alias("center")))
        before, assigned = assigned, Stored(assign_clusters(assigned.df.withColumnRenamed("cluster", "was"), centers), "clusters")
        before.drop()
    n_sites = len(centers.first().center)
    counts = clustered_counts(assigned.df, centers, theta, n_sites)
    return counts.select("s", (F.lit(float(scale)) / F.col("n")).alias("w"))


def _fixed(centers: DataFrame) -> DataFrame:
    """The k centres as a local table, so rounds don't pile up lineage."""
    return centers.sparkSession.createDataFrame(centers.collect(), "cluster int, center array<int>")
