"""Fits by tiles against the driver's fits: values, gradients, iterates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import objective as O
from lattica.operators import optimize as OP
from lattica.operators import tiled as T


def model(n_sites=7, q=3, rows=60, gaps=False, seed=0):
    rng = np.random.RandomState(seed)
    codes = rng.randint(-1 if gaps else 0, q, (rows, n_sites))
    shape = O.Shape(n_sites, q)
    return codes, rng.rand(rows) + 0.1, shape, rng.randn(shape.n) * 0.3


def table(spark, codes, w):
    return spark.createDataFrame([(c.tolist(), float(v)) for c, v in zip(codes, w)], "codes array<int>, w double").repartition(3)


def tiles(spark, layout, shape, x, lam, extra=None):
    """A vector of the model as tiles, by the tables of fields and couplings."""
    e = np.zeros((shape.n_sites, shape.q, shape.n_sites, shape.q))
    e[shape.i, :, shape.j, :] = shape.couplings(x)
    out = []
    for i in range(layout.n_blocks):
        for j in range(i, layout.n_blocks):
            part = e[layout.sites(i), :, layout.sites(j), :].ravel()
            v = np.concatenate([shape.fields(x)[layout.sites(i)].ravel(), part]) if i == j else part
            out.append((i, j, bytearray(np.full((layout.size(i), layout.size(j)), lam).tobytes()), bytearray(v.tobytes())))
    return spark.createDataFrame(out, "i int, j int, lam binary, x binary")


def vector(df, layout, shape, column="x"):
    x = np.zeros(shape.n)
    at = {(i + 1, j + 1): k for k, (i, j) in enumerate(zip(shape.i, shape.j))}
    for r in T.field_rows(df, layout, column).collect():
        shape.fields(x)[r.i - 1, r.a] = r.h
    for r in T.coupling_rows(df, layout, column).collect():
        shape.couplings(x)[at[r.i, r.j], r.a, r.b] = r.e
    return x


@pytest.mark.parametrize("gaps,group,block,parts", [(False, 0.0, 3, 2), (True, 0.5, 2, 3), (False, 0.5, 7, 1), (True, 0.0, 1, 1)])
def test_value_and_gradient_equal_the_present_kernel(spark, gaps, group, block, parts):
    codes, w, shape, x = model(gaps=gaps)
    layout = T.Layout.of(shape.n_sites, shape.q, block)
    own = T.TiledObjective(table(spark, codes, w), layout, 0.1, group, parts)
    points = tiles(spark, layout, shape, x, 0.2).withColumn("d", F.col("x"))
    got = own.at(points)
    f, g = O.LocalObjective(codes, w, shape, np.full(shape.n_sites, 0.1), np.full(len(shape.i), 0.2), group)(x)
    assert np.isclose(got.value, f) and np.isclose(got.slope, g @ x)
    assert np.allclose(vector(got.table.df, layout, shape, "g"), g)


def test_a_task_holds_a_bounded_block_row():
    small = T.Layout.of(100, 21, block_bytes=8 << 20)
    large = T.Layout.of(800, 21, block_bytes=8 << 20)
    for s in (small, large):
        work = T.BlockRow(s, 0, 0)
        assert work.e.nbytes <= 8 << 20
    assert large.block < small.block and large.n_blocks > small.n_blocks


def test_directions_equal_the_two_loops():
    rng = np.random.RandomState(1)
    pairs = [(s, s * rng.rand(20) + 0.1 * s) for s in rng.randn(4, 20)]
    g, x = rng.randn(20), rng.randn(20)
    basis = np.stack([*(s for s, _ in pairs), *(y for _, y in pairs), g, x])
    c = T.direction(basis @ basis.T, [0, 1, 2, 3])
    want = -OP._two_loops(g, [(s, y, float(s @ y)) for s, y in pairs])
    assert np.allclose(c @ basis, want)
    # a pair without curvature is left out
    c = T.direction(basis @ basis.T, [0, 2, 3])
    assert np.allclose(c @ basis, -OP._two_loops(g, [(s, y, float(s @ y)) for s, y in (pairs[0], *pairs[2:])]))


def test_iterates_equal_those_on_the_driver(spark):
    codes, w, shape, _ = model(n_sites=6, rows=40)
    layout = T.Layout.of(6, 3, 2)
    x = np.zeros(shape.n)
    want = OP.lbfgs(O.LocalObjective(codes, w, shape, np.full(6, 0.1), np.full(15, 0.2)), x, 9, 1e-9)
    own = T.TiledObjective(table(spark, codes, w), layout, 0.1, parts=2)
    got = T.minimise(own, T.tiles_of(spark, layout, lambda_e=0.2), 9, 1e-9)
    own.release()
    for a, b in zip(got.history, want.history, strict=True):
        assert a["evaluations"] == b["evaluations"] and all(np.isclose(a[k], b[k], rtol=1e-6) for k in ("value", "gradient", "size", "step"))
    assert got.status is OP.Status.MAX_ITERATIONS
    assert np.allclose(vector(got.table.df, layout, shape), want.x, atol=1e-6)


def test_frozen_fields_start_and_precisions(spark):
    codes, w, shape, _ = model(n_sites=5, rows=30, seed=4)
    layout = T.Layout.of(5, 3, 2)
    fields = spark.createDataFrame([(i + 1, a, float(i - a)) for i in range(5) for a in range(3)], "i int, a int, h double")
    lam = spark.createDataFrame([(int(i) + 1, int(j) + 1, float(i + j)) for i, j in zip(shape.i, shape.j)], "i int, j int, lambda double")
    start = T.tiles_of(spark, layout, fields, lam)
    x = vector(start, layout, shape)
    assert np.allclose(shape.fields(x), [[i - a for a in range(3)] for i in range(5)]) and not shape.couplings(x).any()
    own = T.TiledObjective(table(spark, codes, w), layout, 0.1, parts=1)
    own.frozen = True
    got = T.minimise(own, start, 4, 1e-9)
    local = O.LocalObjective(codes, w, shape, np.full(5, 0.1), shape.i + shape.j + 0.0)
    local.frozen = True
    want = OP.lbfgs(local, x, 4, 1e-9)
    assert np.allclose(vector(got.table.df, layout, shape), want.x, atol=1e-6)
    assert np.allclose(shape.fields(vector(got.table.df, layout, shape)), shape.fields(x))
    assert T.minimise(own, got.table.df.select("i", "j", "lam", "x"), 0, 1e9).status is OP.Status.ALREADY_MINIMAL


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_relational_form_equals_the_kernel(spark, gaps, most):
    codes, w, shape, x = model(n_sites=19, rows=9, gaps=gaps)
    rows = spark.createDataFrame([(k, c.tolist(), float(v)) for k, (c, v) in enumerate(zip(codes, w))], "s long, codes array<int>, w double")
    points = tiles(spark, T.Layout.of(19, 3, 7), shape, x, 0.0).cache()
    h, e = T.field_rows(points, T.Layout.of(19, 3, 7)).cache(), T.coupling_rows(points, T.Layout.of(19, 3, 7)).cache()
    p = O.conditionals(O.energies(rows, h, e, most)).cache()
    f, g = O.LocalObjective(codes, w, shape, np.full(19, 0.1), np.full(len(shape.i), 0.2))(x)
    got = O.negative_log_likelihood(p).first().nll + O.penalty(h, e, 0.1, 0.2).first().penalty
    assert np.isclose(got, f)
    by_field = {(r.i, r.a): r.g for r in O.field_gradient(p, h, 0.1).collect()}
    assert np.allclose([[by_field[i + 1, a] for a in range(3)] for i in range(19)], shape.fields(g))
    by_pair = {(r.i, r.j, r.a, r.b): r.g for r in O.coupling_gradient(p, rows, e, 0.2).collect()}
    assert all(np.isclose(by_pair[i + 1, j + 1, a, b], shape.couplings(g)[k, a, b]) for k, (i, j) in enumerate(zip(shape.i, shape.j)) for a in range(3) for b in range(3))
