"""Letters to codes, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = "abcdefghijklmnopqrstuvwxyz"


def encode(sequence: Column, letters: str, dots_are_gaps: bool) -> Column:
    """array<int>: the index of each letter; a lower-case letter of the alphabet gets its
    index minus q, anything else gets q. Only a-z are folded, as bytes are.

    Code points of a batch of sequences are looked up in one table. A null sequence has no codes."""
    q = len(letters)
    codes: dict[str, int] = {}
    for i, c in enumerate(letters):
        codes.setdefault(c, i)
        if c.isascii() and c.isupper():
            codes.setdefault(c.lower(), i - q)
    if dots_are_gaps and "-" in codes:
        codes["."] = codes["-"]
    if q == 1:  # the scan for a letter never leaves the first one
        return F.transform(F.split(sequence, ""), lambda c: F.when(F.instr(F.lit(_LOW), c) > 0, F.lit(-1)).otherwise(F.lit(0)))
    table = np.full(max(map(ord, codes)) + 2, q, np.int32)
    for c, code in codes.items():
        table[ord(c)] = code

    @F.arrow_udf("array<int>")
    def look_up(seq: pa.Array) -> pa.Array:
        seq = seq.fill_null("")
        points = np.frombuffer("".join(seq.to_pylist()).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(pc.utf8_length(seq).to_numpy(zero_copy_only=False), dtype=np.int32)
        return pa.ListArray.from_arrays(np.append(np.int32(0), ends), table[np.minimum(points, len(table) - 1)])

    return look_up(sequence)


def is_valid(codes: Column, q: int) -> Column:
    """Whether all codes are of the alphabet, in either case. Least and largest code are compiled loops, a lambda for each code isn't."""
    return F.when(codes.isNotNull(), F.coalesce((F.array_min(codes) >= -q) & (F.array_max(codes) < q), F.lit(True)))


def fold_case(codes: Column, q: int) -> Column:
    """Lower-case codes as their upper-case ones."""
    return F.transform(codes, lambda c: F.when(c < 0, c + q).otherwise(c))


def matches(x: Column, y: Column) -> Column:
    """Equal positions of two code arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, m: n + m)
