"""Connected components of an edge table, all in Spark.

Each round every node takes the least label among its neighbours and then the
label of its label (pointer jumping). Only a count of changes reaches the
driver; each round is written to the shared folder, so lost executors cost one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import discard, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b): the least node it reaches."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.where("a <> b").distinct(), "cc-edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("comp")), "cc-0")
    written = None
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        # labels of labels: few labels serve many nodes, so the old table is the small side of a skewed join
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = step.join(jump, "comp", "left").select(
            "node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        step = saved(step, "cc")
        discard(labels if written is None else written)
        changed = step.where("was <> comp").limit(1).count()
        labels, written = step.select("node", "comp"), step
        if not changed:
            discard(both)
            return labels
