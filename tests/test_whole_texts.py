"""Queries on all pieces of the documents against brute force."""

from lattica.plans import catalogue
from lattica.sources.adapters import DOCUMENT_LETTERS as LETTERS


def test_every_piece_is_read(spark, tmp_path):
    head = "The same first letters of"[:24]
    texts = {1: head + " two texts that part later", 2: head + " two texts that end with 7", 3: "Short", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalogue.queries()
    cut = {(d, k // 24): t[k : k + 24].ljust(24) for d, t in texts.items() if t for k in range(0, len(t), 24)}
    bad = {k for k, t in cut.items() if any(c.upper() not in LETTERS for c in t)}

    def by_key(name):
        return {(r.doc_id, r.piece): r for r in q[name](spark, str(tmp_path)).collect()}

    assert by_key("msa_encode_whole").keys() == cut.keys()
    assert by_key("msa_skipped_rows_whole").keys() == bad and bad
    want = {k: ",".join(str(LETTERS.index(c.upper())) for c in t) for k, t in cut.items() if k not in bad}
    assert {k: r.codes for k, r in by_key("msa_valid_rows_whole").items()} == want
    n = {k: sum(sum(x == y for x, y in zip(c.split(","), o.split(","))) >= 0.8 * 24 for o in want.values()) for k, c in want.items()}
    assert {k: r.n for k, r in by_key("neighbor_counts_documents_whole").items()} == n
    assert tuple(q["alignment_lengths_whole"](spark, str(tmp_path)).first()) == (24, 24, len(cut))
