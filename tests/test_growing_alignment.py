"""Neighbour counts of a stream after each micro-batch against those of a batch run."""

import numpy as np
import pytest

from lattica.operators import weights as W
from lattica.streaming import neighbors as N


@pytest.mark.parametrize("theta", [0.0, 0.25, 1.0])
def test_counts_after_every_batch_equal_a_batch_run(spark, tmp_path, theta):
    rng = np.random.RandomState(1)
    codes = rng.randint(0, 3, (40, 8))
    codes[:, :3] = 1  # a segment that all share
    codes[5:9] = codes[5]
    codes[25] = codes[5]
    rows = [(100 + i, c.tolist()) for i, c in enumerate(codes)]
    schema = "s long, codes array<int>"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", N.STORE)
    try:
        came = []
        for k, part in enumerate((rows[:15], rows[15:16], rows[16:])):
            came += part
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = N.keep_additions(N.additions(stream, theta, 8), str(tmp_path / "out"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()
            got = {r.s: r.n for r in N.counts(spark, str(tmp_path / "out")).collect()}
            want = {r.s: r.n for r in W.neighbor_counts(spark.createDataFrame(came, schema), theta, 3).collect()}
            assert got == want, k
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_segments_cover_all_sites():
    assert N.segments(1.0, 8) == [(0, 0)] and N.segments(0.0, 8) == [(0, 8)]
    found = N.segments(0.25, 8)
    assert found[0][0] == 0 and found[-1][1] == 8 and len(found) == 3 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
