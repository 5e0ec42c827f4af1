"""Queries that the Jaccard join makes: none for classes that are settled."""

from lattica.llm import jaccard_join


def made(spark, monkeypatch, rows):
    """Names of the tables that are written for the classes of ``rows``, and the classes."""
    names, saved = [], jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "saved", lambda df, what: names.append(what) or saved(df, what))
    found = jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    return names, {r.doc_id: r.component_id for r in found.collect()}


def words(a, n=60):
    return " ".join(f"w{a}x{i}" for i in range(n))


def test_no_links(spark, monkeypatch):
    names, classes = made(spark, monkeypatch, [(i, words(i)) for i in range(6)] + [(6, None)])
    assert classes == {i: i for i in range(7)}
    assert not {"jaccard-plausible", "jaccard-links", "jaccard-open", "jaccard-groups"} & set(names)


def test_settled_after_a_turn(spark, monkeypatch):
    rows = [(i, words(i % 3) + f" end{i}") for i in range(12)]
    names, classes = made(spark, monkeypatch, rows)
    assert classes == {i: i % 3 for i in range(12)}
    assert names.count("jaccard-links") <= names.count("jaccard-open") <= 3 and "jaccard-groups" not in names
