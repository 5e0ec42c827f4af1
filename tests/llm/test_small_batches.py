"""Arrow batches of the pipeline's stages."""

import pyarrow as pa
import pytest

from lattica.llm import tables

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for batch in batches:
        n = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in n]), pa.array([batch.num_rows] * len(n))], names=["id", "n", "rows"])


def test_batches_are_small_inside_and_whole(spark):
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', IF(id = 7, 5000000, 4096)) AS text")
    seen, before = docs.mapInArrow(sizes, "id long, n long, rows long"), spark.conf.get(KEY, None)
    with tables.small_batches(spark):
        rows = seen.collect()
    assert spark.conf.get(KEY, None) == before
    assert sorted((r.id, r.n) for r in rows) == [(i, 5000000 if i == 7 else 4096) for i in range(3000)]
    assert max(r.rows for r in rows) <= 600
    assert max(r.rows for r in seen.collect()) > 600
    with pytest.raises(ZeroDivisionError), tables.small_batches(spark):
        1 / 0
    assert spark.conf.get(KEY, None) == before


def test_a_saved_table_is_not_written_again(spark):
    found = tables.saved(spark.range(3), "own")
    assert tables.saved(found, "own") is found


def test_python_stages_run_in_small_batches(spark, sf_dir, monkeypatch):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    held, write = {}, tables.saved

    def saved(df, what):
        held[what] = spark.conf.get(KEY)
        return write(df, what)

    monkeypatch.setattr(pipeline, "saved", saved)
    docs = tables.table(spark, sf_dir, "documents")
    for k in (0, 2, 4):
        assert pipeline.STAGES[k][1](spark, docs, sf_dir).count() > 0
    assert [held[x] for x in ("pipeline-language", "pipeline-passages", "pipeline-tokens")] == ["2m"] * 3
    assert spark.conf.get(KEY) != "2m"
