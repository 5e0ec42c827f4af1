"""Near pairs by bit planes, keys and chunks against brute force; pieces of long texts."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import near as N
from lattica.operators import weights as W
from lattica.sources import adapters


def alike(n, sites, letters, seed=0):
    rng = np.random.RandomState(seed)
    codes = rng.randint(0, letters, (12, sites))[rng.randint(0, 12, n)]
    codes = np.where(rng.rand(n, sites) < 0.12, rng.randint(0, letters, codes.shape), codes)
    codes[: n // 10] = codes[0]
    return codes


def rows_of(spark, codes):
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "s long, codes array<int>")


def brute(codes, apart):
    return ((codes[:, None] != codes[None]).sum(axis=2) <= apart).sum(axis=1)


@pytest.mark.parametrize("sites, letters, k", [(24, 29, 2), (24, 29, 3), (33, 3, 1), (64, 3, 2), (70, 20, 1)])
@pytest.mark.parametrize("most", [7, 4096])
def test_keys_equal_brute_force(spark, sites, letters, k, most):
    codes = alike(260, sites, letters)
    shape = N.Shape.of(sites, 0, letters - 1, 4)
    packed = N.packed(rows_of(spark, codes), shape, "s")
    distinct = N.distinct(packed, shape)
    found = N.by_keys(distinct, 260, N.Near(shape, k), most)
    assert {r.s: r.n for r in packed.join(found, shape.names).collect()} == dict(enumerate(brute(codes, 4)))


def test_groups_in_chunks_equal_brute_force(spark):
    codes, groups = alike(200, 30, 5), np.random.RandomState(1).randint(0, 3, 200)
    allowed = {(0, 0), (1, 1), (2, 2), (0, 2), (2, 0)}
    apart = (codes[:, None] != codes[None]).sum(axis=2)
    want = [sum(apart[i, j] <= 5 and (groups[i], groups[j]) in allowed for j in range(200)) for i in range(200)]
    shape = N.Shape.of(30, 0, 4, 5)
    rows = spark.createDataFrame([(i, int(g), c.tolist()) for i, (g, c) in enumerate(zip(groups, codes))], "s long, key long, codes array<int>")
    packed = N.packed(rows, shape, "s", "key")
    found = N.all_with_all(N.distinct(packed, shape, "key"), 200, shape, spark.createDataFrame(sorted(allowed), "key long, other long"), 16)
    assert {r.s: r.n for r in packed.join(found, ["key", *shape.names]).collect()} == dict(enumerate(want))


def test_rows_that_agree_in_more_segments_share_a_key(spark):
    """With one segment a key, each of these rows would meet a third of the others."""
    codes = np.random.RandomState(0).randint(0, 3, (8000, 24))
    shape = N.Shape.of(24, 0, 2, 4)
    assert N.choose(N.distinct(N.packed(rows_of(spark, codes), shape), shape), 10**8, shape) > 1


@pytest.mark.parametrize("broadcast", [0, 1 << 26])
def test_counts_of_many_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(W, "BROADCAST_BYTES", broadcast)
    codes = alike(9000, 16, 3)
    got = {r.s: r.n for r in W.neighbor_counts(rows_of(spark, codes), 0.6, 3).collect()}
    some = range(0, 9000, 300)
    assert [got[i] for i in some] == [((codes[i] == codes).sum(axis=1) >= 0.4 * 16).sum() for i in some]


def test_clusters_of_many_rows_are_met_by_blocks(spark):
    codes = alike(9000, 30, 3)
    assigned = rows_of(spark, codes).withColumn("cluster", (F.col("s") * 0).cast("int"))
    centers = spark.createDataFrame([(0, [0] * 30)], "cluster int, center array<int>")
    began = time.time()
    got = {r.s: r.n for r in W.clustered_counts(assigned, centers, 0.2, 30).collect()}
    assert time.time() - began < 60  # 81 million pairs one by one take minutes
    assert [got[i] for i in range(0, 9000, 300)] == [((codes[i] == codes).sum(axis=1) >= 24).sum() for i in range(0, 9000, 300)]


def test_a_long_text_is_cut_in_one_pass(spark):
    text = "Some words, é and 😀\n" * 200_000
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = adapters.document_pieces(table).select("seq_id.piece", "seq").collect()
    assert time.time() - began < 60  # a walk from the head for each piece takes many minutes
    assert [r.seq for r in sorted(found)] == [text[k : k + 24].ljust(24) for k in range(0, len(text), 24)]
