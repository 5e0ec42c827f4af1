"""Tables as alignments: any table with a key and a fixed number of categorical values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_LETTERS = " ABCDEFGHIJKLMNOPQRSTUVWXYZ.,"


def from_columns(table: DataFrame, key: Column, sites: list[Column]) -> DataFrame:
    """(s, codes) with one integer code for each site expression."""
    return table.select(key.alias("s"), F.array(*[c.cast("int") for c in sites]).alias("codes"))


def embedding_codes(table: DataFrame, sites: int = 16, edge: float = 0.05) -> DataFrame:
    """Three levels of the first dimensions of a vector."""
    def level(v: Column) -> Column:
        v = v.cast("double")
        return F.when(v < -edge, 0).when(v <= edge, 1).otherwise(2)

    return table.select(F.col("vec_id").alias("s"), F.transform(F.slice("embedding", 1, sites), level).alias("codes"))


def document_sequences(table: DataFrame, length: int = 24) -> DataFrame:
    """(seq_id, name, seq): the first characters of long enough texts."""
    return table.where(F.length("text") >= length).select(
        F.col("doc_id").alias("seq_id"), F.col("doc_id").cast("string").alias("name"), F.substring("text", 1, length).alias("seq")
    )


def document_pieces(table: DataFrame, length: int = 24) -> DataFrame:
    """(seq_id, name, seq): all consecutive pieces of every text, keyed by doc_id and piece
    number from 0; the last is padded with the gap letter. Null and empty texts have none,
    and pieces without a doc_id have no name."""
    # one pass over a text: a substring for each piece would start at the text's head each time
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    cut = table.select("doc_id", F.posexplode(pieces).alias("piece", "seq"))
    return cut.select(
        F.struct("doc_id", "piece").alias("seq_id"), F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("piece").cast("string")).alias("name"),
        F.rpad("seq", length, DOCUMENT_LETTERS[0]).alias("seq"),
    )


def lineitem_codes(table: DataFrame) -> DataFrame:
    """Six categorical sites of an order line."""
    def index(c: str, values: str) -> Column:
        return F.instr(F.lit(values), F.col(c)) - 1

    return from_columns(
        table, F.col("l_orderkey"),
        [
            index("l_returnflag", "ANR"), index("l_linestatus", "FO"), F.col("l_linenumber") - 1,
            F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100), F.quarter("l_shipdate") - 1,
        ],
    )
