"""A target is found in the pass that checks lengths."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.operators import alignment as AL
from lattica.options import Options
from lattica.plans import catalogue


@pytest.mark.parametrize("letters", [None, "_*^"])
def test_the_target_is_found_without_a_pass_of_its_own(spark, monkeypatch, letters):
    text = ["AcD-", "A-DE", "C-DE"] if letters is None else ["_*^_", "*_^*", "^^^^"]
    rows = spark.createDataFrame([(2, "x/30-33", text[1]), (1, "x/10-13", text[0]), (3, "y", text[2])], "seq_id long, name string, seq string")
    keyed = rows.withColumn("seq_id", F.struct(F.col("seq_id").alias("a"), F.lit(0).alias("b")))
    o = Options(letters=letters, focus="x", gap_reduce=True)
    want = AL.focus_row(AL.encoded(rows, o), "x")

    def passed(*_):
        raise AssertionError("all rows are encoded to find one")

    monkeypatch.setattr(AL, "focus_row", passed)
    for given in (rows, keyed):
        got = AL.select(given, o)
        assert got.sites == AL.focus_sites(want.codes, o) and got.offsets == [i + 10 for i in got.sites]
    assert AL.select(rows, Options(letters=letters, focus="nobody")).n_sites == 4


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return db


#: An invalid target with and without a valid piece before it, none, one of gaps alone, and pieces without a doc_id.
TARGETS = {
    "before": [(0, "qrSTuv xyz"), (1, "Öab cd eF gh" * 8), (3, "abc")],
    "none before": [(1, "Öabc def ghi" * 3), (2, "abc")],
    "invalid before": [(0, "Öabc def" * 9), (-1, "zxab" * 9), (1, "Öab cd" * 8)],
    "no target": [(0, "abc def"), (2, "Öabc def ghi" * 3)],
    "gaps": [(0, "abc def"), (1, " " * 30)],
    "no doc_id": [(None, "abc def" * 9), (1, "Öab cd" * 8), (3, "abc")],
}


@pytest.mark.parametrize("case", TARGETS)
def test_columns_of_any_target_are_those_of_the_sql(spark, tmp_path, case):
    db = documents(spark, tmp_path, TARGETS[case])
    got = catalogue.queries()["focus_columns"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(catalogue.oracle_sql()["focus_columns"]).fetchall())


@pytest.mark.parametrize("case", TARGETS)
def test_offsets_of_any_target_are_those_of_the_sql(spark, tmp_path, case):
    db = documents(spark, tmp_path, TARGETS[case])
    got = catalogue.queries()["focus_offsets"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(catalogue.oracle_sql()["focus_offsets"]).fetchall())
