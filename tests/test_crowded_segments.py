"""Neighbour counts where many rows share segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import weights as W


def rows_of(spark, codes):
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "s long, codes array<int>")


def common_segments(n=300, sites=12, seed=0):
    """All rows share their first sites; half of them share most of the others too; some are equal."""
    rng = np.random.RandomState(seed)
    codes = rng.randint(0, 4, (n, sites))
    codes[:, :6] = 1
    codes[: n // 2, 6:10] = 2
    codes[:20] = codes[0]
    return codes


@pytest.mark.parametrize("theta", [0.0, 0.1, 0.2, 0.35, 0.6, 1.0])
@pytest.mark.parametrize("most", [8, 50, 4096])
def test_counts_equal_brute_force(spark, theta, most):
    codes = common_segments()
    want = ((codes[:, None] == codes[None]).sum(axis=2) >= (1 - theta) * codes.shape[1]).sum(axis=1)
    rows = rows_of(spark, codes)
    got = rows.join(W._segments(W.distinct_rows(rows).cache(), theta, codes.shape[1], most), "codes").select("s", "n").collect()
    assert {r.s: r.n for r in got} == dict(enumerate(want))


def test_no_key_has_many_rows(spark):
    codes = common_segments(600)
    distinct = W.distinct_rows(rows_of(spark, codes)).cache()
    joins = W.segment_joins(distinct, 0.2, 12, 20)
    assert len(joins) == 3  # segments, segments of the other sites, blocks
    for sides in joins:
        for side in sides[:2]:
            assert side.groupBy("key").count().agg(F.max("count")).first()[0] <= 2 * 20
