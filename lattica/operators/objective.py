"""Regularised symmetric pseudolikelihood: its relational form and its numeric kernel.

Parameters are fields h_i(a) and couplings e_ij(a, b), i < j. Every site is predicted
from all others, and both predictions of a pair share its couplings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.scores import mirrored
from lattica.operators.weights import one_hot
from lattica.sources.stored import Stored

#: Smoothing of the group penalty's square root.
GROUP_SMOOTHING = 0.001


# Relational form ------------------------------------------------------------------------


#: Bytes of couplings, both ways, that may be broadcast to the rows; one has about 40.
BROADCAST_BYTES = 64 << 20
#: Sites predicted by one key of the join beyond that.
SITE_BLOCK = 16


def energies(rows: DataFrame, fields: DataFrame, couplings: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(s, w, i, a, seen, energy): h_i(a) + sum over j of e_ij(a, code of j) for each row, site and code.

    ``rows`` is (s, w, codes); fields join by broadcast. Couplings, of which there are at most the square of the fields, do so while they are
    small; else they are dealt by partner, its code and a block of the predicted sites, which makes as many keys
    more as there are blocks. Gaps (-1) neither predict nor are predicted."""
    long = rows.select("s", "w", F.posexplode("codes").alias("at", "b")).select("s", "w", (F.col("at") + 1).alias("j"), "b").where("b >= 0")
    both = mirrored(couplings.select("i", "j", "a", "b", "e"))
    size = fields.agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("sites")).first()
    if 40 * size.n**2 <= broadcast_bytes:
        met = long.join(F.broadcast(both), ["j", "b"])
    else:
        blocks = F.explode(F.sequence(F.lit(0), F.lit(((size.sites or 1) - 1) // SITE_BLOCK)))
        met = long.withColumn("block", blocks).join(both.withColumn("block", F.floor((F.col("i") - 1) / SITE_BLOCK).cast("int")), ["j", "b", "block"])
    pulls = met.groupBy("s", "i", "a").agg(F.sum("e").alias("pull"))
    own = long.select("s", "w", F.col("j").alias("i"), F.col("b").alias("seen"))
    cells = own.join(F.broadcast(fields), "i")
    return cells.join(pulls, ["s", "i", "a"], "left").select(
        "s", "w", "i", "a", "seen", (F.col("h") + F.coalesce("pull", F.lit(0.0))).alias("energy"))


def conditionals(cells: DataFrame) -> DataFrame:
    """``cells`` with p (softmax over the codes of a site, stabilised by its maximum) and log_z."""
    by = Window.partitionBy("s", "i")
    top = F.max("energy").over(by)
    rows = cells.withColumn("top", top).withColumn("x", F.exp(F.col("energy") - F.col("top")))
    z = F.sum("x").over(by)
    return rows.withColumn("log_z", F.log(z) + F.col("top")).withColumn("p", F.col("x") / z).drop("x", "top")


def negative_log_likelihood(predicted: DataFrame) -> DataFrame:
    return predicted.where("a = seen").agg(F.sum(F.col("w") * (F.col("log_z") - F.col("energy"))).alias("nll"))


def field_gradient(predicted: DataFrame, fields: DataFrame, lambda_h: float) -> DataFrame:
    """(i, a, g)."""
    off = F.col("p") - F.when(F.col("a") == F.col("seen"), 1.0).otherwise(0.0)
    sums = predicted.groupBy("i", "a").agg(F.sum(F.col("w") * off).alias("g"))
    return fields.join(sums, ["i", "a"], "left").select("i", "a", (F.coalesce("g", F.lit(0.0)) + F.lit(2.0 * lambda_h) * F.col("h")).alias("g"))


def coupling_gradient(predicted: DataFrame, rows: DataFrame, couplings: DataFrame, lambda_e: float) -> DataFrame:
    """(i, j, a, b, g): both predictions of a pair are added up on its i < j cell."""
    off = F.col("w") * (F.col("p") - F.when(F.col("a") == F.col("seen"), 1.0).otherwise(0.0))
    residual = predicted.select("s", "i", "a", off.alias("r"))
    other = rows.select("s", F.posexplode("codes").alias("at", "b")).select("s", (F.col("at") + 1).alias("j"), "b").where("b >= 0")
    met = residual.join(other, "s").where("i <> j")
    first = F.col("i") < F.col("j")
    cells = met.select(
        F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "r")
    sums = cells.groupBy("i", "j", "a", "b").agg(F.sum("r").alias("g"))
    return couplings.join(sums, ["i", "j", "a", "b"], "left").select(
        "i", "j", "a", "b", (F.coalesce("g", F.lit(0.0)) + F.lit(2.0 * lambda_e) * F.col("e")).alias("g"))


def penalty(fields: DataFrame, couplings: DataFrame, lambda_h: float, lambda_e: float) -> DataFrame:
    """One row (penalty): lambda x squared, without a half."""
    h = fields.agg(F.sum(F.col("h") * F.col("h") * F.lit(lambda_h)).alias("x"))
    e = couplings.agg(F.sum(F.col("e") * F.col("e") * F.lit(lambda_e)).alias("x"))
    return h.union(e).agg(F.sum("x").alias("penalty"))


def group_penalty(couplings: DataFrame, lambda_group: float) -> DataFrame:
    norms = couplings.groupBy("i", "j").agg(F.sqrt(F.lit(GROUP_SMOOTHING) + F.sum(F.col("e") * F.col("e"))).alias("x"))
    return norms.agg((F.lit(lambda_group) * F.sum("x")).alias("penalty"))


# Numeric kernel -------------------------------------------------------------------------


@dataclass
class Shape:
    """Sites and codes of a model; parameters are one vector, fields first, then the upper
    triangle of couplings by i, j, a, b."""

    n_sites: int
    q: int

    def __post_init__(self) -> None:
        self.i, self.j = np.triu_indices(self.n_sites, 1)
        self.n_fields = self.n_sites * self.q
        self.n = self.n_fields + len(self.i) * self.q * self.q

    def fields(self, x: np.ndarray) -> np.ndarray:
        return x[: self.n_fields].reshape(self.n_sites, self.q)

    def couplings(self, x: np.ndarray) -> np.ndarray:
        return x[self.n_fields :].reshape(-1, self.q, self.q)

    def square(self, x: np.ndarray) -> np.ndarray:
        """Couplings as a symmetric matrix of (site, code) by (site, code)."""
        out = np.zeros((self.n_sites, self.q, self.n_sites, self.q))
        e = self.couplings(x)
        out[self.i, :, self.j, :] = e
        out[self.j, :, self.i, :] = e.transpose(0, 2, 1)
        return out.reshape(self.n_fields, self.n_fields)

    def fold(self, square: np.ndarray) -> np.ndarray:
        """Sum of both triangles as a coupling vector."""
        s = square.reshape(self.n_sites, self.q, self.n_sites, self.q)
        return (s[self.i, :, self.j, :] + s[self.j, :, self.i, :].transpose(0, 2, 1)).ravel()


def likelihood(codes: np.ndarray, w: np.ndarray, x: np.ndarray, shape: Shape, block: int = 512) -> tuple[float, np.ndarray]:
    """Negative log pseudolikelihood of some rows and its gradient, by matrix products."""
    n, q = shape.n_sites, shape.q
    if codes.size and codes.max() >= q:
        raise ValueError(f"code {codes.max()} of {q}")
    # by code, then by site: what is summed over the codes of a site are whole slices
    order = np.arange(shape.n_fields).reshape(n, q).T.ravel()
    square, h = shape.square(x)[np.ix_(order, order)], x[: shape.n_fields][order]
    total, grad_h, grad = 0.0, np.zeros(shape.n_fields), np.zeros((shape.n_fields, shape.n_fields))
    for at in range(0, len(codes), block):
        part, weight = codes[at : at + block], w[at : at + block]
        seen = (part >= 0).astype(np.float64)
        hot = (part[:, None, :] == np.arange(q)[:, None]).astype(np.float64)
        flat = hot.reshape(len(part), -1)
        p = (flat @ square + h).reshape(len(part), q, n)
        own, top = (p * hot).sum(axis=1), p.max(axis=1)
        p -= top[:, None]
        np.exp(p, out=p)
        z = p.sum(axis=1)
        total -= float(weight @ ((own - top - np.log(z)) * seen).sum(axis=1))
        p *= (seen / z)[:, None]
        p -= hot
        p *= weight[:, None, None]
        off = p.reshape(len(part), -1)
        grad_h += off.sum(axis=0)
        grad += flat.T @ off
    place = np.argsort(order)
    return total, np.concatenate([grad_h[place], shape.fold(grad[np.ix_(place, place)])])


class Objective:
    """Value and gradient for an optimizer. ``lambda_h`` is one number per site, ``lambda_e``
    one per pair."""

    def __init__(self, shape: Shape, lambda_h: np.ndarray, lambda_e: np.ndarray, lambda_group: float = 0.0) -> None:
        self.shape, self.lambda_h, self.lambda_e, self.lambda_group = shape, lambda_h, lambda_e, lambda_group
        self.frozen = False  # hold the fields
        self.calls = 0

    def data(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        raise NotImplementedError

    def release(self) -> None:
        """Give back what the rows are held in."""

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        self.calls += 1
        f, g = self.data(x)
        return self.penalised(x, f, g)

    def penalised(self, x: np.ndarray, f: float, g: np.ndarray) -> tuple[float, np.ndarray]:
        s = self.shape
        h, e = s.fields(x), s.couplings(x)
        lh, le = self.lambda_h[:, None], self.lambda_e[:, None, None]
        f += float((lh * h * h).sum() + (le * e * e).sum())
        gh, ge = s.fields(g), s.couplings(g)
        gh += 2 * lh * h
        ge += 2 * le * e
        if self.lambda_group:
            norm = np.sqrt(GROUP_SMOOTHING + (e * e).sum(axis=(1, 2), keepdims=True))
            f += self.lambda_group * float(norm.sum())
            ge += self.lambda_group * e / norm
        if self.frozen:
            gh[:] = 0
        return f, g


class LocalObjective(Objective):
    """Over rows held by the driver; equal rows are summed."""

    def __init__(self, codes: np.ndarray, w: np.ndarray, *args, **kwargs) -> None:
        super().__init__(*args, **kwargs)
        self.codes, self.w = codes, w

    def data(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        return likelihood(self.codes, self.w, x, self.shape)


#: Rows of a block of a shared objective.
BLOCK_ROWS = 4096


class SharedObjective(Objective):
    """Over distinct rows (codes, w) that stay on the executors, as blocks of small integers. The parameters are sent to all tasks, and
    each sends back one value and one gradient, added up over its rows, so what reaches the driver is of the model's size."""

    def __init__(self, distinct: DataFrame, *args, parts: int | None = None, **kwargs) -> None:
        super().__init__(*args, **kwargs)
        spark, n_sites = distinct.sparkSession, self.shape.n_sites
        self.kind = np.int8 if self.shape.q <= 127 else np.int32
        kind = self.kind

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = batch.column(0).flatten().to_numpy().reshape(-1, n_sites).astype(kind)
                w = batch.column(1).to_numpy()
                at = range(0, len(w), BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v[k : k + BLOCK_ROWS].tobytes() for k in at], pa.binary()) for v in (codes, w)], names=["codes", "w"])

        parts = parts or spark.sparkContext.defaultParallelism
        dealt = distinct.select("codes", "w").repartition(parts, F.xxhash64("codes")).sortWithinPartitions("codes")
        self.stored = Stored(dealt.mapInArrow(pack, "codes binary, w binary"), "fit-blocks")

    def data(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        context = self.stored.df.sparkSession.sparkContext
        shared, shape, kind = context.broadcast(x), self.shape, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, grad = 0.0, np.zeros(shape.n)
            for batch in batches:
                for codes, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f, g = likelihood(np.frombuffer(codes, kind).reshape(-1, shape.n_sites).astype(np.int64), np.frombuffer(w), shared.value, shape)
                    value += f
                    grad += g
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([grad.tobytes()], pa.binary())], names=["value", "grad"])

        total, grad = 0.0, np.zeros(shape.n)
        for r in self.stored.df.mapInArrow(run, "value double, grad binary").collect():
            total += r["value"]
            grad += np.frombuffer(r["grad"])
        shared.destroy()
        return total, grad

    def release(self) -> None:
        self.stored.drop()
