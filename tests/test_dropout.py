"""The objective with parameters left out: repeats, partitionings, gradients, means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import dropout as D
from lattica.operators import objective as O
from lattica.operators import tiled as T
from tests.test_tiled import model, table, tiles, vector


def evaluated(spark, codes, w, shape, x, block=2, parts=2, lam=0.2, **k):
    layout = T.Layout.of(shape.n_sites, shape.q, block)
    own = D.DropoutObjective(table(spark, codes, w), layout, 0.1, parts=parts, **k)
    got = own.at(tiles(spark, layout, shape, x, lam).withColumn("d", F.col("x")))
    own.release()
    return got.value, vector(got.table.df, layout, shape, "g"), got.slope


def test_masks_repeat_on_any_partitioning(spark):
    codes, w, shape, x = model(n_sites=6, rows=30, gaps=True)
    a = evaluated(spark, codes, w, shape, x)
    b = evaluated(spark, codes[::-1], w[::-1], shape, x, block=3, parts=1)
    assert np.isclose(a[0], b[0]) and np.allclose(a[1], b[1])
    assert not np.isclose(a[0], evaluated(spark, codes, w, shape, x, seed=1)[0])


def test_all_parameters_kept_is_the_plain_objective(spark):
    codes, w, shape, x = model(n_sites=6, rows=30, gaps=True)
    f, g = O.LocalObjective(codes, w, shape, np.full(6, 0.1), np.full(15, 0.2))(x)
    got = evaluated(spark, codes, w, shape, x, keep=1.0)
    assert np.isclose(got[0], f) and np.allclose(got[1], g)


def by_loops(codes, w, shape, x, seed, keep, lam=0.2):
    h, e = shape.fields(x), np.zeros((shape.n_sites,) * 2 + (shape.q,) * 2)
    for k, (i, j) in enumerate(zip(shape.i, shape.j)):
        e[i, j] = shape.couplings(x)[k]
        e[j, i] = shape.couplings(x)[k].T
    total = 0.1 * (h * h).sum() + lam * (shape.couplings(x) ** 2).sum()
    for row, weight in zip(codes, w):
        key = D.row_keys(row[None], seed)
        for i in range(shape.n_sites):
            if row[i] < 0:
                continue
            energy = []
            for a in range(shape.q):
                v = h[i, a] * D.kept(key, np.array([i * shape.q + a]), keep)[0]
                for j in range(shape.n_sites):
                    if j != i and row[j] >= 0:
                        number = D.coupling_numbers(*(np.array([z]) for z in (i, j, a, row[j])), shape.n_sites, shape.q)
                        v += e[i, j, a, row[j]] * D.kept(key, number, keep)[0]
                energy.append(v)
            total += weight * (np.log(np.exp(energy).sum()) - energy[row[i]])
    return total


def test_value_by_loops_and_gradient_by_differences(spark):
    codes, w, shape, x = model(n_sites=4, rows=12, gaps=True, seed=2)
    value, g, slope = evaluated(spark, codes, w, shape, x, seed=3)
    assert np.isclose(value, by_loops(codes, w, shape, x, 3, 0.5)) and np.isclose(slope, g @ x)
    for k in range(0, shape.n, 7):
        d = np.zeros(shape.n)
        d[k] = 1e-5
        assert abs((by_loops(codes, w, shape, x + d, 3, 0.5) - by_loops(codes, w, shape, x - d, 3, 0.5)) / 2e-5 - g[k]) < 1e-5


def test_pairs_share_bits_and_half_are_kept():
    keys = D.row_keys(np.random.RandomState(0).randint(0, 4, (2000, 9)), 5)
    i, j, a, b = (np.array([v]) for v in (2, 7, 1, 3))
    assert D.coupling_numbers(i, j, a, b, 9, 4) == D.coupling_numbers(j, i, b, a, 9, 4) != D.coupling_numbers(i, j, b, a, 9, 4)
    share = D.kept(keys[:, None], np.arange(100), 0.5).mean(axis=0)
    assert abs(share.mean() - 0.5) < 0.01 and abs(share - 0.5).max() < 0.06


def test_the_mean_over_masks_tends_to_the_plain_value():
    codes, w, shape, x = model(n_sites=5, rows=40, seed=1)
    x = x * 0.2
    layout = T.Layout.of(5, 3, 5)
    plain = O.LocalObjective(codes, w, shape, np.zeros(5), np.zeros(10))(x)[0]

    def value(seed):
        work = D.DroppedBlockRow(layout, 0, 0, seed, 0.5, True)
        e = np.zeros((5, 3, 5, 3))
        e[shape.i, :, shape.j, :] = shape.couplings(x)
        work.place(0, 0, np.concatenate([shape.fields(x).ravel(), e.ravel()]))
        work.meet(codes.astype(np.int8).tobytes(), w)
        return work.value

    means = [np.mean([value(s) for s in range(n)]) for n in (4, 300)]
    single = [value(s) for s in range(300)]
    assert abs(means[1] - plain) < 0.02 * abs(plain) and np.std(single) > 0
    assert means[1] == pytest.approx(np.mean(single))
