"""Tables written to the shared folder between the steps of an iteration."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/lattica-fits").rstrip("/")


class Stored:
    """A table on disk: it has no lineage, any executor reads any part, and it can be dropped when it has been replaced."""

    def __init__(self, df: DataFrame, what: str, folders_by: str | None = None) -> None:
        """``folders_by``: a column whose values get folders of their own, so that a filter on it reads only these."""
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/lattica-{what}-{uuid.uuid4().hex}"
        (df.write.partitionBy(folders_by) if folders_by else df.write).parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        spark = self.df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def kept(df: DataFrame, what: str) -> DataFrame:
    """A table that later steps read several times: stored, or cached on a cluster without a shared folder."""
    try:
        shared_folder(df.sparkSession)
    except ValueError:
        return df.cache()
    return Stored(df, what).df


def release(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that no query refers to any more: Spark's cleaner learns of them when the driver collects."""
    gc.collect()
    spark._jvm.System.gc()
