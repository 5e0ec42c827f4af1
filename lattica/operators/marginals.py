"""Weighted distributions of single sites and of pairs of sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.weights import one_hot

#: Cells of a task's square of (site, code) by (site, code); of larger models pairs are made row by row.
SQUARE_CELLS = 1 << 22
#: Rows of one product.
PRODUCT_ROWS = 2048


def by_vector(rows: DataFrame) -> DataFrame:
    """(codes, w): equal rows summed first, so that pairs are made of distinct rows alone."""
    return rows.groupBy("codes").agg(F.sum("w").alias("w"))


def site_domain(spark, n_sites: int, q: int) -> DataFrame:
    """All (i, a)."""
    cell = F.col("id")
    return spark.range(n_sites * q).select((cell / q).cast("int").alias("_i"), (cell % q).cast("int").alias("a")).select((F.col("_i") + 1).alias("i"), "a")


def pair_domain(spark, n_sites: int, q: int) -> DataFrame:
    """All (i, j, a, b) with i < j."""
    sites = F.sequence(F.col("i") + 1, F.lit(n_sites))
    pairs = spark.range(1, n_sites).select(F.col("id").cast("int").alias("i")).select("i", F.explode(sites).alias("j"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(q * q - 1)))
    return pairs.select("i", "j", cells.alias("c")).select("i", "j", (F.col("c") / q).cast("int").alias("a"), (F.col("c") % q).alias("b"))


def pairs_of(codes: Column, n_sites: int) -> Column:
    """array of struct(i, j, a, b) with i < j, built inside the row: no self-join."""
    def partners(i: int) -> Column:
        def pair(j: Column) -> Column:
            return F.struct(F.lit(i).alias("i"), j.alias("j"), F.get(codes, F.lit(i - 1)).alias("a"), F.get(codes, j - 1).alias("b"))

        return F.transform(F.sequence(F.lit(i + 1), F.lit(n_sites)), pair)

    if n_sites < 40:
        return F.flatten(F.array(*[partners(i) for i in range(1, n_sites)]))
    # one nested expression instead of a branch per site
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(n_sites - 1)),
        lambda i: F.transform(
            F.sequence(i + 1, F.lit(n_sites)),
            lambda j: F.struct(i.alias("i"), j.alias("j"), F.get(codes, i - 1).alias("a"), F.get(codes, j - 1).alias("b")),
        ),
    ))


def site_counts(rows: DataFrame) -> DataFrame:
    """(i, a, n): weight of each code at each site."""
    long = rows.select("w", F.posexplode("codes").alias("at", "a"))
    return long.groupBy((F.col("at") + 1).alias("i"), "a").agg(F.sum("w").alias("n"))


def pair_counts(rows: DataFrame, n_sites: int, q: int | None = None) -> DataFrame:
    """(i, j, a, b, n): weight of each pair of codes at each pair of sites. With ``q``, codes from 0 to q - 1 count alone, and
    tasks add up their rows by matrix products while the model is small."""
    if q is not None and (n_sites * q) ** 2 <= SQUARE_CELLS:
        return _squares(rows, n_sites, q)
    long = by_vector(rows).select("w", F.explode(pairs_of(F.col("codes"), n_sites)).alias("p")).select("w", "p.*")
    return long.groupBy("i", "j", "a", "b").agg(F.sum("w").alias("n"))


def _codes(column: pa.Array, n_sites: int, q: int) -> np.ndarray:
    """(rows, sites) of arrays of codes; what isn't a code from 0 to q - 1, or isn't there, is -1."""
    flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if (size == n_sites).all():
        out = flat.reshape(-1, n_sites)
    else:
        out = np.full((len(size), n_sites), -1)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        own = at < n_sites
        out[np.repeat(np.arange(len(size)), size)[own], at[own]] = flat[own]
    return np.where((out >= 0) & (out < q), out, -1)


def _squares(rows: DataFrame, n_sites: int, q: int) -> DataFrame:
    """(i, j, a, b, n), cells of no weight left out. A task sends each row of its square of sums once, whatever its rows."""
    size = n_sites * q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((size, size))
        for batch in batches:
            codes, w = _codes(batch.column(0), n_sites, q), batch.column(1).cast(pa.float64()).fill_null(0.0).to_numpy()
            for at in range(0, len(w), PRODUCT_ROWS):
                hot = one_hot(codes[at : at + PRODUCT_ROWS], q)
                square += (hot * w[at : at + PRODUCT_ROWS, None]).T @ hot
        used = np.flatnonzero(square.any(axis=1))
        task = np.full(len(used), TaskContext.get().partitionId(), np.int32)
        cells = pa.array([square[r].tobytes() for r in used], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(task), cells], names=["row", "task", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, np.zeros(size)

        def done() -> pa.RecordBatch:
            i, a = divmod(row, q)
            other = np.flatnonzero(total)
            other = other[other // q > i]
            ints = (np.full(len(other), i + 1), other // q + 1, np.full(len(other), a), other % q)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(v.astype(np.int32)) for v in ints), pa.array(total[other])], names=["i", "j", "a", "b", "n"])

        for batch in batches:
            for r, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != row:
                    if row is not None:
                        yield done()
                    row, total = r, np.zeros(size)
                total += np.frombuffer(cells)
        if row is not None:
            yield done()

    # tasks stream their rows, so a few for each core do, whatever the partitions, and bound what is sent
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    sent = rows.select("codes", "w").coalesce(tasks).mapInArrow(run, "row int, task int, cells binary")
    dealt = sent.repartition("row").sortWithinPartitions("row", "task").select("row", "cells")
    return dealt.mapInArrow(add, "i int, j int, a int, b int, n double")


def _dense(counts: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    return domain.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0.0)))


def site_marginals(rows: DataFrame, n_sites: int, q: int, n_eff: float | None = None) -> DataFrame:
    """(i, a, f) for all codes of all sites."""
    total = n_eff if n_eff is not None else rows.agg(F.sum("w")).first()[0]
    dense = _dense(site_counts(rows), site_domain(rows.sparkSession, n_sites, q), ["i", "a"])
    return dense.select("i", "a", (F.col("n") / F.lit(float(total))).alias("f"))


def pair_marginals(rows: DataFrame, n_sites: int, q: int, n_eff: float | None = None) -> DataFrame:
    """(i, j, a, b, f) for all pairs of codes of all pairs of sites."""
    total = n_eff if n_eff is not None else rows.agg(F.sum("w")).first()[0]
    dense = _dense(pair_counts(rows, n_sites, q), pair_domain(rows.sparkSession, n_sites, q), ["i", "j", "a", "b"])
    return dense.select("i", "j", "a", "b", (F.col("n") / F.lit(float(total))).alias("f"))


def _conditional(dense: DataFrame, keys: list[str], cells: int) -> DataFrame:
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy(*keys))
    return dense.withColumn("f", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1.0 / cells))).drop("n")


def site_marginals_gap(rows: DataFrame, n_sites: int, q: int) -> DataFrame:
    """(i, a, f) among rows without a gap (code -1) at the site; uniform where there is none."""
    counts = site_counts(rows).where("a >= 0")
    return _conditional(_dense(counts, site_domain(rows.sparkSession, n_sites, q), ["i", "a"]), ["i"], q).select("i", "a", "f")


def pair_marginals_gap(rows: DataFrame, n_sites: int, q: int) -> DataFrame:
    """(i, j, a, b, f) among rows with gaps at neither site."""
    counts = pair_counts(rows, n_sites, q).where("a >= 0 and b >= 0")
    dense = _dense(counts, pair_domain(rows.sparkSession, n_sites, q), ["i", "j", "a", "b"])
    return _conditional(dense, ["i", "j"], q * q).select("i", "j", "a", "b", "f")


def covariances(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, a, b, e): how far each pair of codes is from independence. Marginal tables
    are of the model's size, so the site table joins by broadcast."""
    left = sites.select("i", "a", F.col("f").alias("fi"))
    right = sites.select(F.col("i").alias("j"), F.col("a").alias("b"), F.col("f").alias("fj"))
    return pairs.join(F.broadcast(left), ["i", "a"]).join(F.broadcast(right), ["j", "b"]).select(
        "i", "j", "a", "b", (F.col("f") - F.col("fi") * F.col("fj")).alias("e"))


def initial_fields(sites: DataFrame, n_eff: float) -> DataFrame:
    """(i, a, h): log of the counts plus one, with mean zero at each site."""
    from pyspark.sql import Window

    h = F.log(F.col("f") * F.lit(float(n_eff)) + 1)
    return sites.select("i", "a", (h - F.avg(h).over(Window.partitionBy("i"))).alias("h"))


def column_information(sites: DataFrame, n_codes: int) -> DataFrame:
    """(i, entropy, information) in bits."""
    h = F.sum(F.when(F.col("f") > 0, -F.col("f") * F.log2("f")).otherwise(0.0))
    return sites.groupBy("i").agg(h.alias("entropy")).withColumn("information", F.log2(F.lit(float(n_codes))) - F.col("entropy"))
