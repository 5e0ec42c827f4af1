"""Queries on all dimensions of the vectors against brute force."""

import numpy as np

from lattica.plans import catalogue


def test_every_dimension_is_a_site(spark, tmp_path):
    x = np.random.RandomState(0).normal(0, 0.1, (12, 64)).astype(np.float32)
    x[1:4] = x[0]
    x[1, 16:] = -x[0, 16:]  # as the first vector in its first 16 dimensions only
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = catalogue.queries()
    c = np.where(x < -0.05, 0, np.where(x <= 0.05, 1, 2))
    n = ((c[:, None] == c[None]).sum(axis=2) >= 0.6 * 64).sum(axis=1)
    w = 1 / n

    def got(name):
        return q[name](spark, str(tmp_path)).collect()

    assert {r.s: r.n for r in got("neighbor_counts_whole")} == dict(enumerate(n))
    assert all(abs(r.w - 2 * w[r.s]) < 1e-5 for r in got("seq_weights_whole"))
    f = np.stack([(w[:, None] * (c == a)).sum(axis=0) for a in range(3)], 1) / w.sum()
    sites = got("site_marginals_whole")
    assert len(sites) == 64 * 3 and all(abs(r.f - f[r.i - 1, r.a]) < 1e-5 for r in sites)
    pairs = got("pair_marginals_whole")
    assert len(pairs) == 2016 * 9
    assert all(abs(r.f - w[(c[:, r.i - 1] == r.a) & (c[:, r.j - 1] == r.b)].sum() / w.sum()) < 1e-5 for r in pairs)
    assert len(got("coupling_table_whole")) == 2016
