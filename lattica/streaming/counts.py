"""Marginals of a growing table by Structured Streaming.

At fixed weights marginals are sums, so a stream of (w, codes) keeps them up to date with
a stateful aggregation of the model's size. Neighbour counts have a module of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.marginals import pairs_of


def streaming_site_counts(stream: DataFrame) -> DataFrame:
    """(i, a, n), for output mode update or complete."""
    long = stream.select("w", F.posexplode("codes").alias("at", "a"))
    return long.groupBy((F.col("at") + 1).alias("i"), "a").agg(F.sum("w").alias("n"))


def streaming_pair_counts(stream: DataFrame, n_sites: int) -> DataFrame:
    """(i, j, a, b, n)."""
    long = stream.select("w", F.explode(pairs_of(F.col("codes"), n_sites)).alias("p")).select("w", "p.*")
    return long.groupBy("i", "j", "a", "b").agg(F.sum("w").alias("n"))
