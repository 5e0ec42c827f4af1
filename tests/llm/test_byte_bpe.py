"""Byte-level BPE: size of its plan, and texts over several chunks and turns of memory."""

import numpy as np
import pytest

from lattica.llm import byte_bpe


def test_plan_does_not_spell_out_the_ranks(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    out = byte_bpe.encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, ["doc_id"])
    assert len(out._jdf.queryExecution().toString()) < 200_000  # the driver keeps the text of each query


def test_ids_over_chunks_and_forgotten_pieces(spark):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = [f"Thanouor{i} été{i % 3} ofthateaing  ~~~{'x' * (i % 40)}\n\n日本{i}語 naïve" for i in range(60)] + ["", None, " ", "ab" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for p in (byte_bpe.BpeParams(chunk_bytes=200, joined_parts=7), byte_bpe.BpeParams(distinct_bytes=300, chunk_bytes=500, joined_parts=1, fold_bytes=20)):
        rows = byte_bpe.encode(docs, path, tokenizers.PATTERN, ["doc_id"], p).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        for r in rows:
            ids = library.encode_ordinary(texts[r.doc_id] or "")
            assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
            assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
