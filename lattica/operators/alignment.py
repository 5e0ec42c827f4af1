"""Selecting rows and sites of an encoded alignment."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import alphabet as A
from lattica.options import Options
from lattica.sources.stored import kept, release


@dataclass
class Alignment:
    """``rows`` (s, codes) hold upper-case codes of the chosen sites; ``raw`` (s, name,
    valid) has every row of the source, so positions can be restored."""

    rows: DataFrame
    raw: DataFrame
    letters: str
    sites: list[int]  # 0-based columns of the source
    offsets: list[int]  # numbers that outputs give to the sites
    focus_letters: list[str] | None
    found: bool = True  # whether there is the target that was asked for

    @property
    def q(self) -> int:
        return len(self.letters)

    @property
    def n_sites(self) -> int:
        return len(self.sites)


def encoded(sequences: DataFrame, o: Options) -> DataFrame:
    """(s, name, codes, valid) of (seq_id, name, seq)."""
    codes = A.encode(F.col("seq"), o.alphabet, o.default_alphabet)
    rows = sequences.select(F.col("seq_id").alias("s"), "name", codes.alias("codes"))
    return rows.withColumn("valid", A.is_valid(F.col("codes"), len(o.alphabet)))


def focus_row(rows: DataFrame, name: str):
    """The first row whose name begins with ``name``."""
    found = rows.where(F.col("name").startswith(name)).orderBy("s").limit(1).collect()
    return found[0] if found else None


def literal(value, kind: T.DataType) -> Column:
    """A value of any key, structs among them."""
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(x, f.dataType).alias(f.name) for x, f in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def valid_before(rows: DataFrame, s):
    """The valid row with the largest key below ``s``. Keys with a null come last."""
    key = rows.schema["s"].dataType
    parts = [F.col("s")[x] for x in key.names] if isinstance(key, T.StructType) else [F.col("s")]
    below = functools.reduce(lambda a, b: a & b, [x.isNotNull() for x in parts], F.col("s") < literal(s, key))
    # rows are looked up once their keys have been compared
    found = rows.where(below).where("valid").orderBy(F.desc("s")).limit(1).collect()
    return found[0] if found else None


def focus_sites(codes: list[int], o: Options) -> list[int]:
    """Columns of the target that are neither lower case nor gaps, as the settings ask."""
    q = len(o.alphabet)
    upper_only, no_gaps = o.default_alphabet, o.default_alphabet or o.gap_reduce
    return [i for i, c in enumerate(codes) if not (upper_only and c < 0) and not (no_gaps and c in (0, -q))]


def region_start(name: str, focus: str) -> int:
    """START of ``focus/START-END``; 1 where there is none."""
    found = re.match(re.escape(focus) + r"/(\d+)", name)
    return int(found[1]) if found else 1


def select(sequences: DataFrame, o: Options = Options()) -> Alignment:
    """Encode, drop rows with an invalid letter anywhere, and keep the target's sites.

    An invalid target leaves its sites in force; the letters shown are those of the
    valid row before it, or none if there is none."""
    rows = encoded(sequences, o)
    q = len(o.alphabet)
    size = F.size("codes") if q == 1 else F.coalesce(F.length("seq"), F.lit(0))
    # lengths and the target's letters in one pass; letters of the target alone are looked up
    least = F.min(F.when(F.col("name").startswith(o.focus), F.struct("seq_id", "name", "seq"))) if o.focus and q > 1 else F.lit(None)
    length = (rows if q == 1 else sequences).select("*", size.alias("n")).agg(F.min("n"), F.max("n"), least.alias("target")).first()
    if length[0] != length[1]:
        raise ValueError(f"sequences have {length[0]} to {length[1]} letters")
    sites, start, shown = list(range(length[0] or 0)), 1, None
    target = None
    if length.target:
        one = sequences.sparkSession.createDataFrame([tuple(length.target)], sequences.select("seq_id", "name", "seq").schema)
        target = encoded(one, o).first()
    elif o.focus and q == 1:
        target = focus_row(rows, o.focus)
    if target:
        sites, start = focus_sites(target.codes, o), region_start(target.name, o.focus)
        shown = target if target.valid else valid_before(rows, target.s)
    if sites == list(range(length[0] or 0)):
        chosen = F.col("codes")
    else:
        chosen = F.transform(F.array(*[F.lit(i) for i in sites]).cast("array<int>"), lambda i: F.get("codes", i))
    valid = rows.where("valid").select("s", A.fold_case(chosen, q).alias("codes"))
    letters = [o.alphabet[shown.codes[i] % q] for i in sites] if shown else None
    return Alignment(
        valid, rows.select("s", "name", "valid"), o.alphabet, sites, [i + start for i in sites] if target else [i + 1 for i in sites], letters,
        bool(target) or not o.focus,
    )


def without_gaps(codes, drop: bool = True):
    """Codes minus one: the first letter becomes -1 and has no parameters."""
    return F.transform(codes, lambda c: c - 1) if drop else F.col(codes)


def long_form(rows: DataFrame, *keep: str) -> DataFrame:
    """(s, i, a, *keep) with sites numbered from 1."""
    return rows.select("s", *keep, F.posexplode("codes").alias("at", "a")).select(
        "s", (F.col("at") + 1).alias("i"), "a", *keep)


def realigned(a: Alignment, weights: DataFrame) -> DataFrame:
    """(s, weight) for every raw row; rows that were dropped have 0. Weights are made first, so that the shuffles they need are
    gone when all rows are dealt."""
    weights = kept(weights, "weights")
    release(weights.sparkSession)
    return a.raw.select("s").join(weights, "s", "left").select("s", F.coalesce("w", F.lit(0.0)).alias("weight"))


def skipped_with_weight(a: Alignment, weights: DataFrame, limit: int = 64) -> DataFrame:
    """Dropped rows for which a weights file has more than 0, at most ``limit`` of them."""
    bad = a.raw.where("not valid").join(weights.where("weight > 0"), a.raw.s == weights.seq_id).select("s", "weight")
    return bad.orderBy("s").limit(limit)
