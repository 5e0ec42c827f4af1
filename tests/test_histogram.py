"""A histogram of scores whose evaluations differ."""

import time

from pyspark.sql import functions as F

from lattica.operators import scores as S


def test_every_score_is_in_a_bin_of_its_own_evaluation(spark):
    @F.udf("double")
    def later(x):
        return x - time.time()

    scores = spark.range(100).select(later.asNondeterministic()(F.col("id") / 1e9).alias("cn"))
    found = S.score_histogram(scores, "cn", 20).collect()
    assert sorted(r.bin for r in found) == list(range(20)) and sum(r.n for r in found) == 100
