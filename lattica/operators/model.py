"""Fitting a pairwise model to an alignment table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import marginals as M
from lattica.operators import scores as S
from lattica.operators import tiled as T
from lattica.operators.objective import LocalObjective, Objective, Shape, SharedObjective, likelihood
from lattica.operators.optimize import Result, adam, lbfgs
from lattica.operators.weights import _matrix
from lattica.options import Options
from lattica.sources.stored import Stored


@dataclass
class PairModel:
    """A fitted model; parameter tables are of the model's size."""

    rows: DataFrame  # (s, codes, w), gaps as -1 where they are left out
    shape: Shape
    options: Options
    n_eff: float
    x: np.ndarray
    result: Result

    @property
    def spark(self):
        return self.rows.sparkSession

    def fields(self) -> DataFrame:
        """(i, a, h)."""
        h = self.shape.fields(self.x)
        i, a = np.indices(h.shape)
        return self._table({"i": i.ravel() + 1, "a": a.ravel()}, {"h": h.ravel()})

    def couplings(self) -> DataFrame:
        """(i, j, a, b, e) with i < j."""
        e, s = self.shape.couplings(self.x), self.shape
        k, a, b = np.indices(e.shape)
        return self._table({"i": s.i[k.ravel()] + 1, "j": s.j[k.ravel()] + 1, "a": a.ravel(), "b": b.ravel()}, {"e": e.ravel()})

    def _table(self, ints: dict, doubles: dict) -> DataFrame:
        columns = {k: pa.array(v.astype(np.int32)) for k, v in ints.items()} | {k: pa.array(v) for k, v in doubles.items()}
        return self.spark.createDataFrame(pa.table(columns))

    def progress(self) -> DataFrame:
        """(iteration, seconds, value, gradient, size, h_norm, e_norm, h_gradient, e_gradient, step, evaluations) of each iteration."""
        kinds = {"iteration": "int", "evaluations": "int"}
        names = ("iteration", "seconds", "value", "gradient", "size", "h_norm", "e_norm", "h_gradient", "e_gradient", "step", "evaluations")
        rows = [tuple(h[k] if k in kinds else float(h[k]) for k in names) for h in self.result.history]
        return self.spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'double')}" for k in names))

    def release(self) -> None:
        """Give back the cached rows; tables of the model that were asked for stay readable from their sources."""
        self.rows.unpersist()

    def scores(self) -> DataFrame:
        """(i, j, fn, cn); after a two-stage fit cn is the norm itself."""
        norms = S.coupling_norms(self.couplings())
        return norms.withColumn("cn", F.col("fn")) if self.options.two_stage else S.apc_scores(norms, self.shape.n_sites)

    def marginals(self) -> tuple[DataFrame, DataFrame]:
        n, q = self.shape.n_sites, self.shape.q
        if self.options.gap_reduce:
            return M.site_marginals_gap(self.rows, n, q), M.pair_marginals_gap(self.rows, n, q)
        return M.site_marginals(self.rows, n, q, self.n_eff), M.pair_marginals(self.rows, n, q, self.n_eff)


@dataclass
class TiledModel(PairModel):
    """A model whose parameters stay in a table of tiles; ``x`` is empty."""

    layout: T.Layout
    stored: Stored

    @property
    def tiles(self) -> DataFrame:
        return self.stored.df

    def release(self) -> None:
        """Give back the cached rows and delete the parameters' table."""
        super().release()
        self.stored.drop()

    def fields(self) -> DataFrame:
        return T.field_rows(self.tiles, self.layout)

    def couplings(self) -> DataFrame:
        return T.coupling_rows(self.tiles, self.layout)


def start(sites: DataFrame, shape: Shape, n_eff: float, fields: bool = True) -> np.ndarray:
    """Fields from the marginals, couplings zero."""
    x = np.zeros(shape.n)
    if fields:
        for r in M.initial_fields(sites, n_eff).collect():
            x[(r.i - 1) * shape.q + r.a] = r.h
    return x


def fit(rows: DataFrame, n_sites: int, q: int, o: Options = Options()) -> PairModel:
    """Fit (s, codes, w). With ``gap_reduce`` code 0 is left out and codes shift down by one."""
    if o.gap_reduce:
        rows, q = rows.withColumn("codes", F.transform("codes", lambda c: c - 1)), q - 1
    rows = rows.cache()
    shape = Shape(n_sites, q)
    n_eff = float(rows.agg(F.sum("w")).first()[0] or 0)
    lambda_h, lambda_e = np.full(n_sites, o.lambda_h), np.full(len(shape.i), o.lambda_e)
    if o.stochastic:
        objective: Objective | None = Bootstrap(rows, o, shape, lambda_h, lambda_e)
    else:
        objective = _objective(rows, o, shape, lambda_h, lambda_e)
    sites = M.site_marginals_gap(rows, n_sites, q) if o.gap_reduce else M.site_marginals(rows, n_sites, q, n_eff)
    if not o.stochastic and objective is None:
        return fit_tiled(rows, sites, shape, n_eff, o)
    model = PairModel(rows, shape, o, n_eff, np.zeros(0), Result(np.zeros(0), 0.0, None))
    x = start(sites, shape, n_eff, fields=not o.two_stage)
    if o.stochastic:
        result = adam(objective, x, o.max_iter, o.compat, n_fields=shape.n_fields)
    else:
        objective.frozen = o.two_stage
        result = lbfgs(objective, x, o.max_iter, o.epsilon, o.history, n_fields=shape.n_fields)
    model.x, model.result = result.x, result
    if o.two_stage:
        # couplings' variances beyond the background set each pair's precision, then fields are freed
        priors = S.variance_priors(S.coupling_variances(model.couplings()), n_sites)
        at = {(i + 1, j + 1): k for k, (i, j) in enumerate(zip(shape.i, shape.j, strict=True))}
        for r in priors.collect():
            objective.lambda_e[at[r.i, r.j]] = r["lambda"]
        objective.frozen = False
        result = lbfgs(objective, start(sites, shape, n_eff), o.max_iter, o.epsilon, o.history, n_fields=shape.n_fields)
        model.x, model.result = result.x, result
    objective.release()
    return model


def _objective(rows: DataFrame, o: Options, shape: Shape, lambda_h, lambda_e) -> Objective | None:
    """Distinct rows on the driver while they are few, shared by the executors while the parameters are few, else None."""
    if shape.n > o.local_parameters:
        return None
    distinct = M.by_vector(rows).cache()
    try:
        cells = distinct.count() * shape.n_sites
        if cells > o.local_cells or cells > o.driver_cells and shape.n > o.shared_parameters:
            return None
        if cells > o.driver_cells:
            return SharedObjective(distinct, shape, lambda_h, lambda_e, o.lambda_group)
        found = distinct.orderBy("codes").toArrow()
    finally:
        distinct.unpersist()
    return LocalObjective(_matrix(found.column("codes"), shape.n_sites), found.column("w").to_numpy(), shape, lambda_h, lambda_e, o.lambda_group)


def fit_tiled(rows: DataFrame, sites: DataFrame, shape: Shape, n_eff: float, o: Options) -> TiledModel:
    """The fit with parameters and rows on the executors; ``sites`` are the site marginals."""
    spark = rows.sparkSession
    layout = T.Layout.of(shape.n_sites, shape.q, o.site_block)
    objective = T.TiledObjective(rows, layout, o.lambda_h, o.lambda_group)
    fields = M.initial_fields(sites, n_eff)

    def run(precisions: DataFrame | None = None, with_fields: bool = True) -> T.TiledResult:
        begun = T.tiles_of(spark, layout, fields if with_fields else None, precisions, o.lambda_e)
        return T.minimise(objective, begun, o.max_iter, o.epsilon, o.history)

    objective.frozen = o.two_stage
    found = run(with_fields=not o.two_stage)
    if o.two_stage:
        objective.frozen = False
        priors = S.variance_priors(S.coupling_variances(T.coupling_rows(found.table.df, layout)), shape.n_sites)
        before, found = found, run(priors.select("i", "j", "lambda"))
        before.table.drop()
    objective.release()
    result = Result(np.zeros(0), found.value, found.status, found.history)
    return TiledModel(rows, shape, o, n_eff, np.zeros(0), result, layout, found.table)


class Bootstrap(Objective):
    """Objective of weighted draws of rows with replacement, scaled to all rows. Only the drawn rows come to the driver."""

    def __init__(self, rows: DataFrame, o: Options, shape: Shape, lambda_h, lambda_e) -> None:
        super().__init__(shape, lambda_h, lambda_e, o.lambda_group)
        self.o = o
        self.raw = np.random.RandomState(o.seed)
        self.index = SampleIndex(rows)

    def data(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        n, total = self.o.batch, self.index.total
        drawn = self.index.draw(self.raw.random_sample(n) * total).toArrow()
        f, g = likelihood(_matrix(drawn.column("codes"), self.shape.n_sites), drawn.column("times").to_numpy().astype(float), x, self.shape)
        return f * total / n, g * total / n

    def release(self) -> None:
        self.index.release()


class SampleIndex:
    """Rows (s, codes, w) in buckets by order of s, each in a folder of its own. A point of the running sum of all
    weights is looked up in the buckets' totals first; then only the buckets that are hit are read."""

    def __init__(self, rows: DataFrame, bucket_rows: int = 4096, most_buckets: int = 4096) -> None:
        n = rows.count()
        size = max(bucket_rows, -(-n // most_buckets))
        kind = rows.schema["s"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, row, total = TaskContext.get().partitionId() << 20, 0, 0.0
            for batch in batches:
                w, at = batch.column(2).to_numpy(), np.arange(row, row + batch.num_rows)
                hi, lo = np.empty(len(w)), np.empty(len(w))
                for bucket in np.unique(at // size):
                    own = at // size == bucket
                    start = total if row and own[0] and row % size else 0.0
                    hi[own] = start + np.cumsum(w[own])
                    lo[own] = np.concatenate([[start], hi[own][:-1]])
                if len(w):
                    total = float(hi[-1])
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(lo), pa.array(hi), pa.array(part + at // size, pa.int64())], names=["s", "codes", "lo", "hi", "bucket"])

        placed = rows.select("s", "codes", "w").repartitionByRange("s").sortWithinPartitions("s")
        self.stored = Stored(placed.mapInArrow(run, f"s {kind}, codes array<int>, lo double, hi double, bucket long"), "fit-samples", "bucket")
        sums = sorted((r.bucket, r.t) for r in self.stored.df.groupBy("bucket").agg(F.max("hi").alias("t")).collect())
        self.buckets = np.array([b for b, _ in sums], np.int64)
        self.ends = np.cumsum([t for _, t in sums])
        self.total = float(self.ends[-1]) if sums else 0.0

    def draw(self, points: np.ndarray) -> DataFrame:
        """(s, codes, times): rows whose stretch (lo, hi] of the running sum holds one of ``points`` (a fixed batch), and how many."""
        points = np.sort(points)
        at = np.minimum(np.searchsorted(self.ends, points, side="left"), len(self.ends) - 1)
        hit, first = np.unique(at, return_index=True)
        base = np.concatenate([[0.0], self.ends])
        # what each bucket that is hit looks up, from its own start
        own = {int(self.buckets[b]): x - base[b] for b, x in zip(hit, np.split(points, first[1:]), strict=True)} if len(points) else {}
        rows = self.stored.df.where(F.col("bucket").isin([*own]) if own else F.lit(False))
        shared = rows.sparkSession.sparkContext.broadcast(own)
        kind = rows.schema["s"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lo, hi, bucket = (batch.column(k).to_numpy() for k in (2, 3, 4))
                times = np.zeros(batch.num_rows, np.int64)
                for b in np.unique(bucket):
                    mine, p = bucket == b, shared.value[int(b)]
                    times[mine] = np.searchsorted(p, hi[mine], side="right") - np.searchsorted(p, lo[mine], side="right")
                keep = pa.array(times > 0)
                yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns[:2]), pa.array(times[times > 0])], names=["s", "codes", "times"])

        return rows.select("s", "codes", "lo", "hi", "bucket").mapInArrow(run, f"s {kind}, codes array<int>, times long")

    def release(self) -> None:
        self.stored.drop()
