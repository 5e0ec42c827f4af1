"""Pseudolikelihood fits whose parameters stay on the executors.

Sites are cut into blocks; a tile (I, J), I <= J, holds the couplings of two blocks, a diagonal tile also the block's
fields. Every vector of the fit (parameters, gradient, the pairs that limited-memory BFGS remembers) is a column of one
table of tiles, written to the shared folder after each iteration.

One evaluation takes two shuffles. A task of the first holds the block row of couplings of one block of sites and meets a part of the
rows: it predicts the block's sites and sends its gradient tile by tile. The second adds up tiles as they
stream by and puts the penalty on. A block row has at most ``block_bytes``, whatever the number of sites; rows come in
chunks. The driver sees sums: the value, the slope, and the table of dot products of the remembered vectors, from
which it finds the coefficients of the next direction (Chen, Wang and Zhou 2014, vector-free L-BFGS).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lattica.operators.line_search import Search, strong_wolfe
from lattica.operators.objective import GROUP_SMOOTHING
from lattica.operators.optimize import Status
from lattica.operators.weights import one_hot
from lattica.sources.stored import Stored

#: Bytes of a block row of couplings (all sites by the sites of one block).
BLOCK_BYTES = 32 << 20
#: Cells of codes in one chunk of rows.
CHUNK_CELLS = 1 << 18


@dataclass(frozen=True)
class Layout:
    """Sites in blocks of ``block``; tiles are flat vectors: fields of a diagonal tile first, then couplings by
    site, code, other site, other code. Cells of a diagonal tile that aren't of a pair i < j stay zero."""

    n_sites: int
    q: int
    block: int

    @staticmethod
    def of(n_sites: int, q: int, block: int | None = None, block_bytes: int = BLOCK_BYTES) -> Layout:
        return Layout(n_sites, q, block or int(max(1, min(32, block_bytes // (8 * n_sites * q * q)))))

    @property
    def n_blocks(self) -> int:
        return -(-self.n_sites // self.block)

    def sites(self, at: int) -> slice:
        return slice(at * self.block, min(self.n_sites, (at + 1) * self.block))

    def size(self, at: int) -> int:
        span = self.sites(at)
        return span.stop - span.start

    def split(self, v: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Views of a tile's fields (site, code; empty off the diagonal) and couplings (site, code, site, code)."""
        n = self.size(i) * self.q if i == j else 0
        return v[:n].reshape(-1, self.q), v[n:].reshape(self.size(i), self.q, self.size(j), self.q)

    def length(self, i: int, j: int) -> int:
        return self.size(i) * self.q * (self.size(j) * self.q + (i == j))

    def pairs(self, i: int, j: int) -> np.ndarray:
        """Which (site, site) of a tile are pairs of the model."""
        return np.triu(np.ones((self.size(i), self.size(j)), bool), 1) if i == j else np.ones((self.size(i), self.size(j)), bool)


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def chunks(rows: DataFrame, layout: Layout, parts: int) -> DataFrame:
    """(part, chunk, codes, w): distinct rows in chunks, codes as small integers, dealt to ``parts``."""
    n, kind = layout.n_sites, np.int8 if layout.q <= 127 else np.int32
    most = max(1, CHUNK_CELLS // n)
    distinct = rows.groupBy("codes").agg(F.sum("w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).flatten().to_numpy().reshape(-1, n).astype(kind)
            w = batch.column(1).to_numpy()
            at = range(0, len(w), most)
            yield pa.RecordBatch.from_arrays(
                [pa.array([codes[k : k + most].tobytes() for k in at], pa.binary()), pa.array([w[k : k + most].tobytes() for k in at], pa.binary())], names=["codes", "w"])

    # all rows of a task in one order, so that chunks and sums repeat
    found = distinct.sortWithinPartitions("codes").mapInArrow(run, "codes binary, w binary")
    key = F.xxhash64("codes", "w")
    return found.select((F.pmod(key, F.lit(parts))).cast("int").alias("part"), key.alias("chunk"), "codes", "w")


@dataclass
class Evaluation:
    table: Stored  # (i, j, x, g, value, slope)
    value: float
    slope: float


class TiledObjective:
    """Value and gradient of the penalised negative log pseudolikelihood, tile by tile."""

    def __init__(self, rows: DataFrame, layout: Layout, lambda_h: float, lambda_group: float = 0.0, parts: int | None = None) -> None:
        self.layout, self.lambda_h, self.lambda_group, self.frozen = layout, lambda_h, lambda_group, False
        spark = rows.sparkSession
        self.parts = parts or max(1, spark.sparkContext.defaultParallelism // layout.n_blocks)
        self.chunks = Stored(chunks(rows, layout, self.parts), "fit-rows")
        self.calls = 0
        #: What a task works with: layout, block and task give a :class:`BlockRow`.
        self.block_row: Callable[[Layout, int, int], BlockRow] = BlockRow

    def release(self) -> None:
        self.chunks.drop()

    def at(self, points: DataFrame) -> Evaluation:
        """``points`` is (i, j, lam, x, d): parameters, and the direction whose slope is wanted."""
        self.calls += 1
        # both sums are taken while the tiles are written
        sums = Observation()
        table = Stored(self._summed(points, self._sent(points)).observe(sums, F.sum("value").alias("value"), F.sum("slope").alias("slope")), "fit-trial")
        return Evaluation(table, sums.get["value"], sums.get["slope"])

    def _sent(self, points: DataFrame) -> DataFrame:
        """(i, j, kind, task, x, d, lam, value): gradient tiles of each block of sites and part of the rows."""
        layout, blocks, block_row = self.layout, self.layout.n_blocks, self.block_row
        tiles = points.select(
            F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), "i", "j", "x"
        ).select("part", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), F.lit(0).alias("kind"), (F.col("i") * blocks + F.col("j")).cast("long").alias("key"), F.col("x").alias("a"), F.lit(None).cast("binary").alias("b"))
        rows = self.chunks.df.select(
            "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("chunk").alias("key"), F.col("codes").alias("a"), F.col("w").alias("b"))
        both = tiles.union(rows).withColumn("task", F.col("part") * blocks + F.col("block"))
        dealt = both.repartitionById(self.parts * blocks, "task").sortWithinPartitions("task", "kind", "key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work: BlockRow | None = None
            for batch in batches:
                part, block, kind, key, a, b, task = (c.to_pylist() for c in batch.columns)
                for k in range(batch.num_rows):
                    if work is None or work.task != task[k]:
                        if work is not None:
                            yield from work.tiles()
                        work = block_row(layout, block[k], task[k])
                    if kind[k] == 0:
                        work.place(*divmod(key[k], blocks), _vector(a[k]))
                    else:
                        work.meet(a[k], _vector(b[k]))
            if work is not None:
                yield from work.tiles()

        return dealt.mapInArrow(run, "i int, j int, kind int, task int, x binary, d binary, lam binary, value double")

    def _summed(self, points: DataFrame, sent: DataFrame) -> DataFrame:
        layout, lambda_h, lambda_group, frozen = self.layout, self.lambda_h, self.lambda_group, self.frozen
        own = points.select("i", "j", F.lit(0).alias("kind"), F.lit(-1).alias("task"), "x", "d", "lam", F.lit(0.0).alias("value"))
        dealt = own.union(sent).repartition("i", "j").sortWithinPartitions("i", "j", "kind", "task")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict | None = None

            def done() -> pa.RecordBatch:
                i, j, x = held["i"], held["j"], _vector(held["x"])
                g, value = held["g"], held["value"]
                h, e = layout.split(x, i, j)
                gh, ge = layout.split(g, i, j)
                lam = _vector(held["lam"]).reshape(layout.size(i), layout.size(j))[:, None, :, None]
                value += lambda_h * float((h * h).sum()) + float((lam * e * e).sum())
                gh += 2 * lambda_h * h
                ge += 2 * lam * e
                if lambda_group:
                    norm = np.sqrt(GROUP_SMOOTHING + (e * e).sum(axis=(1, 3)))
                    value += lambda_group * float(norm[layout.pairs(i, j)].sum())
                    ge += lambda_group * e / norm[:, None, :, None]
                if frozen:
                    gh[:] = 0
                slope = float(g @ _vector(held["d"])) if held["d"] is not None else 0.0
                columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([held["x"]], pa.binary()), pa.array([g.tobytes()], pa.binary()), pa.array([value]), pa.array([slope])]
                return pa.RecordBatch.from_arrays(columns, names=["i", "j", "x", "g", "value", "slope"])

            for batch in batches:
                for r in batch.to_pylist():
                    if r["kind"] == 0:
                        if held is not None:
                            yield done()
                        held = r | {"g": np.zeros(layout.length(r["i"], r["j"]))}
                    else:
                        held["g"] += _vector(r["x"])
                        held["value"] += r["value"]
            if held is not None:
                yield done()

        return dealt.mapInArrow(run, "i int, j int, x binary, g binary, value double, slope double")


class BlockRow:
    """All couplings of one block of sites, and what predictions of these sites add to the gradient."""

    def __init__(self, layout: Layout, block: int, task: int) -> None:
        self.layout, self.block, self.task = layout, block, task
        n, q = layout.size(block), layout.q
        self.h = np.zeros((n, q))
        self.e = np.zeros((layout.n_sites, q, n, q))
        self.value, self.grad_h, self.grad = 0.0, np.zeros((n, q)), None

    def place(self, i: int, j: int, x: np.ndarray) -> None:
        h, e = self.layout.split(x, i, j)
        if i == j:
            self.h[:] = h
            self.e[self.layout.sites(i)] = e + e.transpose(2, 3, 0, 1)
        elif i == self.block:
            self.e[self.layout.sites(j)] = e.transpose(2, 3, 0, 1)
        else:
            self.e[self.layout.sites(i)] = e

    def meet(self, codes: bytes, w: np.ndarray) -> None:
        s, q = self.layout, self.layout.q
        codes = np.frombuffer(codes, np.int8 if q <= 127 else np.int32).reshape(len(w), s.n_sites)
        flat = self.e.reshape(s.n_sites * q, -1)
        if self.grad is None:
            self.grad = np.zeros_like(flat)
        # one-hot rows take q doubles a cell
        step = max(1, CHUNK_CELLS // (s.n_sites * q) * 4)
        for at in range(0, len(w), step):
            part, weight = codes[at : at + step].astype(np.int64), w[at : at + step]
            hot = one_hot(part, q)
            mine = part[:, s.sites(self.block)]
            energy = (hot @ flat).reshape(len(part), -1, q) + self.h
            top = energy.max(axis=2, keepdims=True)
            p = np.exp(energy - top)
            z = p.sum(axis=2, keepdims=True)
            p /= z
            rows, sites = np.nonzero(mine >= 0)
            log_p = energy[rows, sites, mine[rows, sites]] - (np.log(z) + top)[rows, sites, 0]
            self.value -= float((weight[rows] * log_p).sum())
            off = p * (mine >= 0)[:, :, None]
            off[rows, sites, mine[rows, sites]] -= 1
            off *= weight[:, None, None]
            self.grad_h += off.sum(axis=0)
            self.grad += hot.T @ off.reshape(len(part), -1)

    def tiles(self) -> Iterator[pa.RecordBatch]:
        s, own = self.layout, self.block
        if self.grad is None:  # no rows came
            return
        grad = self.grad.reshape(self.e.shape)
        for other in range(s.n_blocks):
            part = grad[s.sites(other)]  # other's site, code by own site, code
            if other == own:
                both = part + part.transpose(2, 3, 0, 1)
                both = both * s.pairs(own, own)[:, None, :, None]
                yield self._tile(own, own, np.concatenate([self.grad_h.ravel(), both.ravel()]), self.value)
            elif other < own:
                yield self._tile(other, own, np.ascontiguousarray(part).ravel(), 0.0)
            else:
                yield self._tile(own, other, np.ascontiguousarray(part.transpose(2, 3, 0, 1)).ravel(), 0.0)

    def _tile(self, i: int, j: int, v: np.ndarray, value: float) -> pa.RecordBatch:
        none = pa.array([None], pa.binary())
        columns = [pa.array([x], pa.int32()) for x in (i, j, 1, self.task)] + [pa.array([v.tobytes()], pa.binary()), none, none, pa.array([value])]
        return pa.RecordBatch.from_arrays(columns, names=["i", "j", "kind", "task", "x", "d", "lam", "value"])


# Parameters ------------------------------------------------------------------------------


def tiles_of(
    spark, layout: Layout, fields: DataFrame | None = None, precisions: DataFrame | None = None, lambda_e: float = 0.0, couplings: DataFrame | None = None,
) -> DataFrame:
    """(i, j, lam, x): parameters as tiles. ``fields`` is (i, a, h), sites from 1; ``couplings`` (i, j, a, b, e), else they are zero;
    ``precisions`` (i, j, lambda), else all are ``lambda_e``."""
    n, block = layout.n_blocks, layout.block
    tiles = spark.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).where("i <= j")

    def listed(table: DataFrame, keys, cell, name: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.collect_list(cell).alias(name))

    if fields is not None:
        at = F.floor((F.col("i") - 1) / block).cast("int")
        own = listed(fields.where("i is not null"), [at.alias("fi")], F.struct((F.col("i") - 1).alias("site"), "a", "h"), "fields")
        tiles = tiles.join(own, (F.col("i") == F.col("fi")) & (F.col("i") == F.col("j")), "left").drop("fi")
    else:
        tiles = tiles.withColumn("fields", F.array().cast("array<struct<site:int,a:int,h:double>>"))
    if precisions is not None:
        bi, bj = (F.floor((F.col(c) - 1) / block).cast("int") for c in ("i", "j"))
        own = listed(precisions, [bi.alias("pi"), bj.alias("pj")], F.struct((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("lambda").alias("v")), "precisions")
        tiles = tiles.join(own, (F.col("i") == F.col("pi")) & (F.col("j") == F.col("pj")), "left").drop("pi", "pj")
    else:
        tiles = tiles.withColumn("precisions", F.array().cast("array<struct<i:int,j:int,v:double>>"))

    if couplings is not None:
        bi, bj = (F.floor((F.col(c) - 1) / block).cast("int") for c in ("i", "j"))
        own = listed(couplings, [bi.alias("ci"), bj.alias("cj")], F.struct((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "a", "b", "e"), "couplings")
        tiles = tiles.join(own, (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj")), "left").drop("ci", "cj")
    else:
        tiles = tiles.withColumn("couplings", F.array().cast("array<struct<i:int,j:int,a:int,b:int,e:double>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                i, j = r["i"], r["j"]
                x, lam = np.zeros(layout.length(i, j)), np.full((layout.size(i), layout.size(j)), lambda_e)
                h, e = layout.split(x, i, j)
                for c in r["couplings"] or ():
                    e[c["i"] - layout.sites(i).start, c["a"], c["j"] - layout.sites(j).start, c["b"]] = c["e"]
                for c in r["fields"] or ():
                    h[c["site"] - layout.sites(i).start, c["a"]] = c["h"]
                for c in r["precisions"] or ():
                    lam[c["i"] - layout.sites(i).start, c["j"] - layout.sites(j).start] = c["v"]
                columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([lam.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "lam", "x"])

    return tiles.mapInArrow(run, "i int, j int, lam binary, x binary")


def field_rows(tiles: DataFrame, layout: Layout, column: str = "x") -> DataFrame:
    """(i, a, h), sites from 1, of a vector of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, _ = layout.split(_vector(v), i, i)
                site, a = np.indices(h.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((site.ravel() + layout.sites(i).start + 1).astype(np.int32)), pa.array(a.ravel().astype(np.int32)), pa.array(h.ravel())], names=["i", "a", "h"])

    return tiles.where("i = j").select("i", column).mapInArrow(run, "i int, a int, h double")


def coupling_rows(tiles: DataFrame, layout: Layout, column: str = "x") -> DataFrame:
    """(i, j, a, b, e) with i < j, sites from 1, of a vector of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, e = layout.split(_vector(v), i, j)
                m, a, n, b = np.indices(e.shape)
                m, n = m + layout.sites(i).start + 1, n + layout.sites(j).start + 1
                keep = (m < n).ravel()
                columns = [pa.array(c.ravel()[keep].astype(np.int32)) for c in (m, n, a, b)] + [pa.array(e.ravel()[keep])]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "a", "b", "e"])

    return tiles.select("i", "j", column).mapInArrow(run, "i int, j int, a int, b int, e double")


# Limited-memory BFGS by dot products ---------------------------------------------------------

_STATE = "i int, j int, lam binary, x binary, g binary, s array<binary>, y array<binary>, dots array<double>, h double, hg double"


def _next_state(before: DataFrame | None, trial: DataFrame, lam: DataFrame, keep: list[int], layout: Layout) -> DataFrame:
    """Tiles after a step: the remembered pairs at the places ``keep`` and the new one; ``dots`` are the tile's products of
    all s, all y, the gradient and the parameters with each other, h and hg the squares of its fields and of their gradient."""
    new = trial.select("i", "j", "x", "g")
    if before is None:
        none = F.array().cast("array<binary>")
        both = lam.select("i", "j", "lam").join(new, ["i", "j"]).select("i", "j", "lam", "x", "g", F.lit(None).cast("binary").alias("x0"), F.lit(None).cast("binary").alias("g0"), none.alias("s"), none.alias("y"))
    else:
        old = before.select("i", "j", "lam", F.col("x").alias("x0"), F.col("g").alias("g0"), "s", "y")
        both = old.join(new, ["i", "j"]).select("i", "j", "lam", "x", "g", "x0", "g0", "s", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, g = _vector(r["x"]), _vector(r["g"])
                s, y = [r["s"][k] for k in keep], [r["y"][k] for k in keep]
                if r["x0"] is not None:
                    s.append((x - _vector(r["x0"])).tobytes())
                    y.append((g - _vector(r["g0"])).tobytes())
                basis = np.stack([*map(_vector, s), *map(_vector, y), g, x])
                columns = [pa.array([r[k]], pa.int32()) for k in ("i", "j")] + [pa.array([r[k]], pa.binary()) for k in ("lam", "x", "g")]
                columns += [pa.array([v], pa.list_(pa.binary())) for v in (s, y)] + [pa.array([(basis @ basis.T).ravel()], pa.list_(pa.float64()))]
                h, hg = (layout.split(v, r["i"], r["j"])[0] for v in (x, g))
                columns += [pa.array([float((v * v).sum())]) for v in (h, hg)]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "lam", "x", "g", "s", "y", "dots", "h", "hg"])

    return both.mapInArrow(run, _STATE)


def _dots(state: DataFrame) -> np.ndarray:
    """Products of the remembered vectors: all that reaches the driver, a table of 2 * memory + 2 a side."""
    sums = state.select(F.posexplode("dots").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    n = int(round(len(sums) ** 0.5))
    out = np.empty(n * n)
    for r in sums:
        out[r.k] = r.v
    return out.reshape(n, n)


def direction(dots: np.ndarray, use: list[int]) -> np.ndarray:
    """Coefficients over (s, y, gradient, parameters) of minus the inverse Hessian of the pairs ``use`` times the gradient."""
    m = (len(dots) - 2) // 2
    c = np.zeros(len(dots))
    c[2 * m] = 1.0
    kept = {}
    for k in reversed(use):
        kept[k] = dots[k] @ c / dots[k, m + k]
        c[m + k] -= kept[k]
    if use:
        k = use[-1]
        c *= dots[k, m + k] / dots[m + k, m + k]
    for k in use:
        c[k] += kept[k] - dots[m + k] @ c / dots[k, m + k]
    return -c


def _points(state: DataFrame, coefficients: np.ndarray, step: float) -> DataFrame:
    """(i, j, lam, x, d): parameters ``step`` along the direction with these coefficients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _vector(r["x"])
                d = np.zeros_like(x)
                for c, v in zip(coefficients, (*r["s"], *r["y"], r["g"], r["x"]), strict=True):
                    if c:
                        d += c * _vector(v)
                columns = [pa.array([r[k]], pa.int32()) for k in ("i", "j")] + [pa.array([v], pa.binary()) for v in (r["lam"], (x + step * d).tobytes(), d.tobytes())]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "lam", "x", "d"])

    return state.select("i", "j", "lam", "x", "g", "s", "y").mapInArrow(run, "i int, j int, lam binary, x binary, d binary")


def _norms(dots: np.ndarray, fields: dict) -> dict:
    """Sizes of fields and couplings and of their gradients, from the sums over all tiles."""
    rest = {"e_norm": dots[-1, -1] - fields["h"], "e_gradient": dots[-2, -2] - fields["hg"]}
    return {k: float(np.sqrt(max(v, 0.0))) for k, v in {"h_norm": fields["h"], "h_gradient": fields["hg"], **rest}.items()}


@dataclass
class TiledResult:
    table: Stored  # (i, j, lam, x, g, s, y, dots)
    value: float
    status: Status
    history: list[dict] = field(default_factory=list)


def minimise(objective: TiledObjective, start: DataFrame, max_iter: int = 0, epsilon: float = 1e-3, memory: int = 6, search: Search = Search()) -> TiledResult:
    """Limited-memory BFGS from ``start`` (i, j, lam, x); the same iterates as :func:`lattica.operators.optimize.lbfgs`."""
    layout, began = objective.layout, time.monotonic()
    first = Stored(start, "fit-start")
    found = objective.at(first.df.select("i", "j", "lam", "x", F.lit(None).cast("binary").alias("d")))
    state = Stored(_next_state(None, found.table.df, first.df, [], layout), "fit-state")
    first.drop()
    found.table.drop()
    dots, use, value = _dots(state.df), [], found.value
    result = TiledResult(state, value, Status.CONVERGED)
    size = lambda k: float(np.sqrt(max(dots[k, k], 0.0)))  # noqa: E731  -2 the gradient, -1 the parameters
    if size(-2) <= epsilon * max(1.0, size(-1)):
        result.status = Status.ALREADY_MINIMAL
        return result
    step, t = 1 / size(-2), 0
    while True:
        c = direction(dots, use)
        seen: list[Evaluation] = []

        def phi(at: float) -> tuple[float, float]:
            if seen:
                seen.pop().table.drop()
            seen.append(objective.at(_points(state.df, c, at)))  # noqa: B023
            return seen[0].value, seen[0].slope

        found_step = strong_wolfe(phi, value, float(dots[-2] @ c), step, search)
        if found_step is None:
            result.status = Status.LINE_SEARCH
            return result
        t += 1
        trial, value = seen[0].table, seen[0].value
        keep = use[-(memory - 1) :] if memory > 1 else []
        sums = Observation()
        after = Stored(_next_state(state.df, trial.df, None, keep, layout).observe(sums, F.sum("h").alias("h"), F.sum("hg").alias("hg")), "fit-state")
        state.drop()
        trial.drop()
        state, dots = after, _dots(after.df)
        m = (len(dots) - 2) // 2
        use = [k for k in range(m) if dots[k, m + k] > 0]
        result.table, result.value = state, value
        result.history.append({"iteration": t, "value": value, "gradient": size(-2), "size": size(-1), "step": float(found_step[0]), "evaluations": found_step[1], "seconds": time.monotonic() - began} | _norms(dots, sums.get))
        if size(-2) <= epsilon * max(1.0, size(-1)):
            return result
        if max_iter and t >= max_iter:
            result.status = Status.MAX_ITERATIONS
            return result
        step = 1.0
