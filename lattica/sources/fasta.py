"""Alignment files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(raw: DataFrame) -> DataFrame:
    """(seq_id, value): rows of a text file with their place in it."""
    raw = raw.select(F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_part"), "value")
    sizes = raw.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("lo"))
    before = sizes.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return raw.join(F.broadcast(before), "_part").select((F.col("_at") - F.col("lo") + F.col("before")).alias("seq_id"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, name, seq): one row for each record, in file order.

    Spark splits the file at line breaks followed by ``>``. Records get ids by their
    place in the file: monotonic partition ids are turned into a running number with
    one row per partition in the middle, so no step has all rows in one task. Wrapped
    lines are joined, carriage returns and blank lines are dropped. A file that
    doesn't begin with ``>`` and records of unequal length are errors.
    """
    rows = _numbered(spark.read.text(path, lineSep="\n>"))
    first = F.col("seq_id") == 0
    marked = F.when(first & ~F.col("value").startswith(">"), F.raise_error(F.lit("an alignment begins with '>'"))).otherwise(
        F.when(first, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    )
    rows = rows.withColumn("value", marked)
    return rows.select(
        "seq_id",
        F.regexp_replace(F.substring_index("value", "\n", 1), "\r", "").alias("name"),
        F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), "[\r\n]", "").alias("seq"),
    )


def check_lengths(sequences: DataFrame) -> int:
    """The common length of all sequences; unequal ones are an error."""
    lo, hi = sequences.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if lo is None:
        raise ValueError("the alignment has no sequences")
    if lo != hi:
        raise ValueError(f"sequences have {lo} to {hi} letters")
    return lo


def read_weights(spark: SparkSession, path: str, n_rows: int) -> DataFrame:
    """(seq_id, weight) from a text file with one number for each raw sequence."""
    lines = _numbered(spark.read.text(path))
    found = lines.count()
    if found != n_rows:
        raise ValueError(f"{found} weights for {n_rows} sequences")
    return lines.select("seq_id", F.trim("value").cast("double").alias("weight"))


def read_couplings(spark: SparkSession, path: str) -> DataFrame:
    """(i, a_i, j, a_j, zero, score) from a couplings text file."""
    return spark.read.csv(path, sep=" ", schema="i int, a_i string, j int, a_j string, zero int, score double")
