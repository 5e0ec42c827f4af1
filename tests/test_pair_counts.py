"""Pair counts by matrix products, and tables of the model's size that are made once."""

import numpy as np
import pytest

from lattica.operators import marginals as M
from lattica.plans import catalogue


def counted(df):
    return {(r.i, r.j, r.a, r.b): r.n for r in df.collect()}


@pytest.mark.parametrize("low", [0, -1])
def test_products_equal_pairs_made_row_by_row(spark, low):
    rng = np.random.RandomState(1)
    rows = spark.createDataFrame([(c.tolist(), float(w)) for c, w in zip(rng.randint(low, 3, (5000, 7)), rng.rand(5000))], "codes array<int>, w double")
    got = counted(M.pair_counts(rows.repartition(5), 7, 3))
    want = {k: n for k, n in counted(M.pair_counts(rows, 7)).items() if k[2] >= 0 and k[3] >= 0}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)


def test_odd_rows_count_as_before(spark):
    rows = spark.createDataFrame([([0, 1, 2], 1.0), ([0, None, 2], 2.0), ([5, 1], 4.0), ([], 8.0), (None, 16.0), ([0, 1, 2, 2], None), ([2, 1, 0, 1], 32.0)], "codes array<int>, w double")
    got = {k: n for k, n in counted(M.pair_counts(rows, 3, 3)).items() if n}
    kept = {k: n for k, n in counted(M.pair_counts(rows, 3)).items() if n and None not in k and k[2] < 3 and k[3] < 3}
    assert got == kept
    assert M.pair_counts(rows.where("false"), 3, 3).count() == 0


def test_marginals_make_no_row_for_each_pair_of_sites(spark):
    rows = spark.createDataFrame([([0, 1, 2], 1.0)], "codes array<int>, w double")
    plan = M.pair_counts(rows, 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    dense = M.pair_marginals(rows, 3, 3, 1.0)
    assert dense.count() == 27 and dense.where("f = 1").count() == 3


def test_scores_read_kept_couplings(spark, sf_dir):
    plan = catalogue.apc_scores(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # norms and both backgrounds read the table that is kept, nothing of the rows
    assert "Join LeftOuter" not in plan.split("InMemoryRelation")[0] and "mapinarrow" not in plan.lower().split("inmemoryrelation")[0]
    assert plan.count("InMemoryRelation") >= 3
