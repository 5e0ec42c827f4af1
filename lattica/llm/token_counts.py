"""Token counts by a public tokenizer, lengths only.

Texts go to the library in batches of about equal bytes. With a byte-level
vocabulary that adds no prefix space, texts are first split at safe boundaries: a
single space before an ASCII letter always begins a new piece of the pre-tokenizer,
and no special string holds a space, so the counts of the parts add up to the count
of the text. Each distinct part of a batch is encoded once, and counts of short
parts are remembered in a table of bounded size.

Defined cases: a null text counts as empty, an empty text has 0 tokens; special
strings inside texts are handled as the library's default; no truncation or
padding; rows are counted one by one, so repeated rows and extra columns change
nothing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.arrays import chunks

_SAFE = re.compile(r"(?<=\S)(?= [A-Za-z])")


@dataclass(frozen=True)
class CountParams:
    batch_bytes: int = 1 << 18
    #: Parts whose counts are remembered, and the longest of them.
    remembered: int = 600_000
    remembered_chars: int = 64
    limit: int = 1024


def json_counter(data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Batch counter of a tokenizers file, and whether its texts may be split."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(data)
    t.no_truncation()
    t.no_padding()
    kind = t.pre_tokenizer.__getstate__().decode() if t.pre_tokenizer else ""
    split = (
        '"ByteLevel"' in kind and '"add_prefix_space":false' in kind and t.normalizer is None
        and not any(" " in a.content or a.lstrip or a.rstrip for a in t.get_added_tokens_decoder().values())
    )
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)], split


def piece_counter(data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(x) for x in s.encode(texts, num_threads=1)], False


class PartCounter:
    """Counts texts through batches of distinct parts, balanced by bytes."""

    def __init__(self, counter: Callable[[list[str]], list[int]], split: bool, p: CountParams) -> None:
        self.counter, self.split, self.p = counter, split, p
        self.known: dict[str, int] = {}

    def _learn(self, parts: set[str]) -> dict[str, int]:
        """Counts of parts too long to be remembered; short ones join the table."""
        long: dict[str, int] = {}
        batch, size = [], 0
        for part in [*parts, None]:
            if part is not None:
                batch.append(part)
                size += len(part.encode())
            if batch and (part is None or size >= self.p.batch_bytes):
                for x, n in zip(batch, self.counter(batch), strict=True):
                    (self.known if len(x) <= self.p.remembered_chars else long)[x] = n
                batch, size = [], 0
        return long

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.p.remembered:
            self.known.clear()
        if not self.split:
            long = self._learn(set(texts).difference(self.known))
            return [self.known[t] if t in self.known else long[t] for t in texts]
        parts = [_SAFE.split(t) for t in texts]
        long = self._learn(set().union(*parts).difference(self.known))
        if long:
            return [sum(self.known[x] if x in self.known else long[x] for x in own) for own in parts]
        get = self.known.__getitem__
        return [sum(map(get, own)) for own in parts]


def count_tokens(docs: DataFrame, path: str, keep: list[str], p: CountParams = CountParams()) -> DataFrame:
    """``keep`` columns of ``docs`` with n_bytes, n_tokens and over_limit, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # one vocabulary file
    make = piece_counter if path.endswith(".model") else json_counter
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if counter is None:
                counter = PartCounter(*make(shared.value), p)
            n, texts = [], batch.column(batch.num_columns - 1)
            for c in chunks(texts, 1 << 20):
                n += counter(texts.slice(c.rows.start, c.n).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    counted = source.mapInArrow(run, f"{schema}, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > p.limit)
