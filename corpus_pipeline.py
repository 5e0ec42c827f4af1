"""A training corpus from ``documents``: language ID, near duplicates, repeated passages,
benchmark leaks, tokens. Each stage takes what its predecessor kept. An executor keeps the heap that earlier
stages made it touch, so stages with Python functions are written here, in small Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from lattica.llm import byte_bpe, decontamination, jaccard_join, language_id, substring_dedup
from lattica.llm.tables import fold, saved, small_batches, table

#: Least probability of the predicted language; a text without a letter has none.
LEAST_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; texts without a letter go."""
    model = language_id.fit(docs, learn=fold("doc_id", 4) != 2)
    found = language_id.prediction(spark, F.col("text"), model)
    known = (F.col("_found.lang_pred") != language_id.UNDETERMINED) & (F.col("_found.score") >= LEAST_SCORE)
    with small_batches(spark):
        return saved(docs.withColumn("_found", found).where(known).select(*docs.columns), "pipeline-language")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of a row's plain columns: a private key where doc_ids repeat or are missing."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays: the one with the least doc_id,
    of several with that doc_id or without any the one whose row has the least hash. Rows that
    are the same in all plain columns are one; a text without words is linked with nothing."""
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id"), _row_hash(docs).alias("row"))
    keyed = docs.withColumn("_key", own)
    with small_batches(spark):
        classes = jaccard_join.similarity_classes(keyed.select(F.col("_key").alias("doc_id"), "text"))
        stays = classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
        stays = saved(stays, "pipeline-stays")
    kept = keyed.join(stays.select("_id"), F.col("_key") == F.col("_id"), "left_semi")
    if stays.where("_n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_key"])
    return kept.drop("_key")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that already occur in an earlier document are cut out; a document that
    loses every word goes. n_chars follows the text. Rows without a doc_id have no order and keep theirs."""
    with small_batches(spark):
        cleaned = substring_dedup.clean_texts(docs, substring_dedup.repeated_spans(docs)).where("text is not null")
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
        return saved(cleaned, "pipeline-passages")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go; rows count
    by themselves, with or without a doc_id of their own."""
    keyed = docs.withColumn("_key", _row_hash(docs))
    found = decontamination.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = saved(found.select(F.col("doc_id").alias("_id")).distinct(), "pipeline-leaks")
    return keyed.join(leaks, F.col("_key") == F.col("_id"), "left_anti").drop("_key")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers as P

    small = byte_bpe.BpeParams(distinct_bytes=3 << 20, chunk_bytes=1 << 18)  # less memory than alone, for some more time
    coded = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"], small)
    with small_batches(spark):
        return saved(coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")), "pipeline-tokens")


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmarks),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the language network nor byte-level merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
