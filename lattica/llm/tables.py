"""Reading the driver's tables and the few Spark idioms the operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the column's text modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    folder of its own; a cluster's executors and driver share no local folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/lattica-checkpoints").rstrip("/")


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that :func:`saved` has written and :func:`discard` may delete.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "2m") -> contextlib.AbstractContextManager[None]:
    """What is run inside gets Arrow batches of about ``size`` (a longer row is a batch of its own). An executor holds a batch of
    each Python function of each task several times over: as vectors, as the bytes that are sent, and in the worker."""
    return _setting(spark, _BATCH_BYTES, size)


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage is cut
    and any executor can read every part. Its shuffle files go when it is written.
    A table that was got from here is returned as it is."""
    if df in _folders:
        return df
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lattica-{what}-{uuid.uuid4().hex}"
    with _setting(spark, _SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`saved` that nothing reads any more."""
    for df in tables:
        path = _folders.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(text: Column, most: int, parts: int = 16) -> Column:
    """A text of at most ``most`` characters as it is; of a longer one ``parts`` stretches, evenly from its first character
    to its last, joined by a line end. So training reads all of a text's length and holds no more than ``most``."""
    size = F.length(text)
    piece = most // parts - 1
    starts = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.floor(k * (size - piece) / (parts - 1)).cast("int") + 1)
    return F.when(size > most, F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(piece))), "\n")).otherwise(text)


def bounded_sample(df: DataFrame, n: int, most: int, by: str | None = None) -> DataFrame:
    """At most ``n`` rows of ``df`` (doc_id, text and others), of each value of ``by`` where given: those whose doc_id and
    then whose other columns have the smallest hashes. Rows without a doc_id or with an empty text don't count, so rows are
    found wherever there are any. Neither the order of rows nor chance decides. Texts are :func:`spread`."""
    usable = df.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    # rows whose hash is in the lowest part of all hashes, four times as many as are wanted, so that few are held to be ordered
    own = [] if by is None else [by]
    many = usable.groupBy(*own).agg(F.count(F.lit(1)).alias("_many"))
    low = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) * F.col("_many") <= 4.0 * n + 100
    near = usable.join(F.broadcast(many), own) if own else usable.crossJoin(F.broadcast(many))
    near = near.where(low).select(*df.columns).withColumn("_hash", F.xxhash64(*df.columns)).withColumn("text", spread(F.col("text"), most))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_hash")]
    if by is None:
        return near.orderBy(*order).limit(n).drop("_hash")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank", "_hash")


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int, most: int) -> list[tuple]:
    """Sorted (doc_id, text, quality) of at most ``n`` labelled rows of ``docs``, chosen among all that have a label;
    several labels of one doc_id count as the least."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = docs.select("doc_id").join(marked, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").withColumn("_hash", F.xxhash64("text"))
    rows = rows.withColumn("text", spread(F.col("text"), most)).orderBy(F.xxhash64("doc_id"), "doc_id", "_hash").limit(n)
    return sorted((r.doc_id, r.text, r.quality) for r in rows.collect())
