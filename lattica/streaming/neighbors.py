"""Neighbour counts of a growing alignment by Structured Streaming.

Rows meet as in the batch join on segments: of d + 1 segments of sites at least one agrees where at most d sites differ. Each
segment and its codes are a key with state, the rows that have come so far. A new row is compared with the state of its keys and with
the new rows beside it; a pair counts at the first segment in which it agrees. What comes out are additions to the counts of
both rows, so a row that came long ago grows as well; weights are the reciprocals of the sums.

The session needs a state store for lists: ``STORE`` as ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from lattica.operators.weights import least_matches

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key's state that are held at once.
BLOCK = 4096


def segments(theta: float, n_sites: int) -> list[tuple[int, int]]:
    """First and end of each segment of sites; one without sites where no segment need agree."""
    d = max(0, n_sites - max(0, least_matches(theta, n_sites)))
    if d >= n_sites:
        return [(0, 0)]
    cuts = np.linspace(0, n_sites, d + 2).astype(int)
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Meeting(StatefulProcessor):
    """Additions (s, n) to the counts of rows that share a segment."""

    def __init__(self, theta: float, n_sites: int) -> None:
        self.spans, self.least = segments(theta, n_sites), (1 - theta) * n_sites

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "s long, codes array<int>")

    def near(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """Which rows of x are near to which of y and agree in no segment before k."""
        same = x[:, None, :] == y[None, :, :]
        out = same.sum(axis=2) >= self.least
        for a, b in self.spans[:k]:
            out &= ~same[:, :, a:b].all(axis=2)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        k = int(key[0].split(":", 1)[0])
        found = pd.concat(list(rows))
        s, x = found["s"].to_numpy(np.int64), np.array(found["codes"].tolist(), np.int64)
        # a row meets itself once, in its first segment
        n = np.full(len(s), int(k == 0), np.int64)
        for at in range(0, len(s), 256):
            for to in range(0, len(s), 256):
                near = self.near(x[at : at + 256], x[to : to + 256], k)
                if at == to:
                    np.fill_diagonal(near, False)
                n[at : at + 256] += near.sum(axis=1)
        before = self.rows.get()
        while block := list(islice(before, BLOCK)):
            t, y = np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.int64)
            more = np.zeros(len(t), np.int64)
            for at in range(0, len(s), 64):
                near = self.near(x[at : at + 64], y, k)
                n[at : at + 64] += near.sum(axis=1)
                more += near.sum(axis=0)
            if more.any():
                yield pd.DataFrame({"s": t[more > 0], "n": more[more > 0]})
        self.rows.appendList([(int(a), [int(c) for c in b]) for a, b in zip(s, x, strict=True)])
        if n.any():
            yield pd.DataFrame({"s": s[n > 0], "n": n[n > 0]})

    def close(self) -> None:
        pass


def additions(stream: DataFrame, theta: float, n_sites: int) -> DataFrame:
    """(s, n): what each micro-batch of (s, codes) adds to the neighbour counts; s is a whole number."""
    part = lambda a, b: F.array_join(F.transform(F.slice("codes", a + 1, b - a), lambda c: c.cast("string")), ",")
    keys = F.array(*[F.concat(F.lit(f"{k}:"), part(a, b)) for k, (a, b) in enumerate(segments(theta, n_sites))])
    cut = stream.select(F.col("s").cast("long").alias("s"), "codes", F.explode(keys).alias("key"))
    return cut.groupBy("key").transformWithStateInPandas(Meeting(theta, n_sites), "s long, n long", "append", "none")


def keep_additions(found: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of :func:`additions` to a folder for each batch; a batch that is run again takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("s").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(s, n): neighbours of each row so far, itself included."""
    return spark.read.schema("s long, n long, batch int").parquet(folder).groupBy("s").agg(F.sum("n").alias("n"))
