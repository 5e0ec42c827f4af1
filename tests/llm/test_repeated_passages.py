"""Substring dedup on passages that repeat inside documents, inside other passages and in rows of one doc_id."""

import random

import pytest

from lattica.llm import substring_dedup as S
from tests.llm.test_llm import brute_dedup, story


def result(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in S.deduplicate(df, ["doc_id"]).collect())


def test_a_region_that_its_first_document_holds_twice(spark):
    passage = story(1, 60)
    region = f"{story(2, 80)} {passage} {story(3, 80)}"
    docs = [(1, passage), (2, f"{region} {story(4, 7)} {region}"), (3, region)]
    got = result(spark, docs)
    assert got == sorted(brute_dedup(docs))
    assert [r[2] for r in got] == [0, 120, 220]


def test_rows_of_one_doc_id_that_share_a_region(spark):
    passage = story(1, 60)
    region = f"{story(2, 80)} {passage} {story(3, 80)}"
    docs = [(1, passage), (12, f"{region} {story(4, 9)}"), (12, f"{story(5, 9)} {region}"), (13, f"{story(6, 30)} {region}")]
    got = result(spark, docs)
    assert got == sorted(brute_dedup(docs))
    assert [r[2] for r in got] == [0, 60, 60, 220]


def corpus(seed):
    """A few documents that share passages, passages of passages, and repeat them; a vocabulary of its own."""
    rng = random.Random(seed)

    def fresh(n):
        return [f"c{seed}w{rng.randrange(rng.choice([3, 40, 4000]))}" for _ in range(n)]

    pool = [fresh(rng.randrange(20, 140)) for _ in range(3)]
    for _ in range(3):
        a, b = rng.choice(pool), rng.choice(pool)
        cut = rng.randrange(len(a))
        pool.append(a[:cut] + b + a[cut:] if rng.random() < 0.5 else a[cut // 2 :] + b)
    docs = []
    for _ in range(rng.randrange(2, 7)):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += rng.choice(pool) if rng.random() < 0.75 else fresh(rng.randrange(1, 60))
        docs.append((seed * 10 + rng.randrange(5), " ".join(own)))
    return docs


@pytest.mark.parametrize("first", [0, 200])
def test_random_corpora(spark, first):
    docs = [d for seed in range(first, first + 200) for d in corpus(seed)]
    want = sorted(brute_dedup(docs))
    assert sum(r[2] > 0 for r in want) > 200
    assert result(spark, docs) == want
