"""Fits whose rows stay on the executors while the driver steers: values, gradients, routes."""

import numpy as np
import pytest

from lattica.operators import model as PM
from lattica.operators import objective as O
from lattica.options import Options


def table(spark, codes, w):
    return spark.createDataFrame([(k, c.tolist(), float(v)) for k, (c, v) in enumerate(zip(codes, w))], "s long, codes array<int>, w double").repartition(3)


@pytest.mark.parametrize("gaps,group,parts", [(False, 0.0, 2), (True, 0.5, 3), (False, 0.5, 40)])
def test_sums_of_tasks_equal_those_of_the_driver(spark, gaps, group, parts):
    rng = np.random.RandomState(2)
    codes, w = rng.randint(-1 if gaps else 0, 3, (60, 7)), rng.rand(60) + 0.1
    shape = O.Shape(7, 3)
    x, rest = rng.randn(shape.n) * 0.3, (shape, np.full(7, 0.1), np.full(len(shape.i), 0.2), group)
    shared = O.SharedObjective(table(spark, codes, w), *rest, parts=parts)
    (f, g), (f0, g0) = shared(x), O.LocalObjective(codes, w, *rest)(x)
    shared.release()
    assert np.isclose(f, f0, rtol=1e-12) and np.allclose(g, g0, rtol=1e-10)


@pytest.mark.parametrize("k", [{}, {"gap_reduce": True}, {"two_stage": True}, {"lambda_group": 0.5}])
def test_a_fit_of_many_rows_keeps_them_off_the_driver(spark, k, monkeypatch):
    rng = np.random.RandomState(3)
    rows = table(spark, rng.randint(0, 3, (300, 6)), rng.rand(300) + 0.1)
    o = {"lambda_h": 0.1, "lambda_e": 0.5, "epsilon": 1e-7, **k}
    local = PM.fit(rows, 6, 3, Options(**o))

    def held(*_, **__):
        raise AssertionError("the driver holds the rows")

    monkeypatch.setattr(PM, "LocalObjective", held)
    shared = PM.fit(rows, 6, 3, Options(**o, driver_cells=100))
    assert np.allclose(shared.x, local.x, atol=1e-6) and shared.result.status == local.result.status
    # as many as a table of 1 GB has
    assert Options().driver_cells < 102564 * 64


def test_large_models_of_many_rows_go_by_tiles(spark):
    rng = np.random.RandomState(4)
    rows = table(spark, rng.randint(0, 3, (100, 5)), np.ones(100))
    model = PM.fit(rows, 5, 3, Options(lambda_e=1.0, max_iter=1, driver_cells=100, shared_parameters=10))
    assert isinstance(model, PM.TiledModel)
