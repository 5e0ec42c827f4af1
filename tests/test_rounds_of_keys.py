"""Keys of near rows are shuffled in rounds, and a round's files go before those of later ones pile up."""

import os

import numpy as np
import pandas as pd
import pytest

from lattica.functions.alphabet import is_valid
from lattica.operators import alignment as AL
from lattica.operators import near as N
from lattica.options import Options

SITES, ROWS = 24, 60_000


def shuffled(spark):
    """Bytes of shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return sum(os.path.getsize(f) for f in files if "/shuffle_" in f and os.path.exists(f))


def test_the_disk_holds_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(N, "ROUND_ROWS", ROWS, raising=False)
    codes = np.random.RandomState(0).randint(0, 29, (ROWS, SITES)).astype(np.int32)
    shape = N.Shape.of(SITES, 0, 28, 4)
    columns = dict(zip(shape.names, shape.pack(codes).view(np.int64)))
    frame = spark.createDataFrame(pd.DataFrame(columns | {"copies": np.ones(ROWS, np.int64)})).cache()
    assert frame.count() == ROWS
    base, seen = shuffled(spark), []

    class Watched(N.Stored):
        def __init__(self, *a):
            super().__init__(*a)
            seen.append(shuffled(spark) - base)

    monkeypatch.setattr(N, "Stored", Watched)
    near = N.Near(shape, 2)
    assert N.by_keys(frame, ROWS, near).agg({"n": "sum"}).first()[0] >= ROWS
    assert max(seen) < 20 * ROWS * len(near.choices) // 2  # a key's row takes over 20 bytes


@pytest.mark.parametrize("rounds", [1, 300, 1000])
@pytest.mark.parametrize("most", [7, 4096])
def test_counts_don_t_depend_on_rounds(spark, monkeypatch, rounds, most):
    rng = np.random.RandomState(1)
    codes = np.where(rng.rand(260, SITES) < 0.12, rng.randint(0, 29, (260, SITES)), rng.randint(0, 29, (12, SITES))[rng.randint(0, 12, 260)])
    codes[:60] = codes[0]
    monkeypatch.setattr(N, "ROUND_ROWS", rounds, raising=False)
    shape = N.Shape.of(SITES, 0, 28, 4)
    packed = N.packed(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "s long, codes array<int>"), shape, "s")
    distinct = N.distinct(packed, shape)
    found = N.by_keys(distinct, distinct.count(), N.Near(shape, 1), most)
    want = ((codes[:, None] != codes[None]).sum(axis=2) <= 4).sum(axis=1)
    assert {r.s: r.n for r in packed.join(found, shape.names).collect()} == dict(enumerate(want))


def test_weights_are_made_before_all_rows_are_dealt(spark):
    rows = spark.createDataFrame([(1, "a", "AC"), (2, "b", "A?"), (3, "c", "AD")], "seq_id long, name string, seq string")
    a = AL.select(rows, Options())
    weights = a.rows.groupBy("s").count().select("s", (1.0 / (N.F.col("count") + 1)).alias("w"))
    found = AL.realigned(a, weights)
    assert "Aggregate" in weights._jdf.queryExecution().toString() and "Aggregate" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0.5), (2, 0.0), (3, 0.5)]


def test_codes_of_the_alphabet(spark):
    rows = spark.createDataFrame([([0, -3, 2],), ([0, 3],), ([-4, 0],), ([],), (None,)], "codes array<int>")
    assert [r[0] for r in rows.select(is_valid(N.F.col("codes"), 3)).collect()] == [True, False, False, True, None]
