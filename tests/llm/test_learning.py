"""Training samples of every shape, and scores of the trained models by plain formulas."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm import language_id as L
from lattica.llm import quality_classifier as Q
from lattica.llm import quality_rules as R
from lattica.llm.tables import bounded_sample, labelled_sample, spread

ENGLISH, FRENCH = "the water of that house was with them ", "une maison et les eaux qui étaient près "


def test_labels_without_documents_leave_the_sample_full(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 1000, 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 10 % 2) for i in range(10000)] + [(0, 5), (None, 1), (10, None)], "doc_id long, quality int")
    assert len(labelled_sample(docs, labels, 200, 1000)) == 100
    rows = labelled_sample(docs.where("doc_id >= 500"), labels, 20, 1000)
    assert len(rows) == 20 and all(i >= 500 and t == f"text {i}" and y == i // 10 % 2 for i, t, y in rows)


def test_long_texts_are_sampled_over_their_length(spark):
    text = "".join(chr(97 + k * 26 // 100_000) for k in range(100_000))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "text string").select(spread(F.col("text"), 1600).alias("t")).collect()
    assert got[1].t == "short" and got[2].t is None
    assert len(got[0].t) <= 1600 and got[0].t[0] == "a" and got[0].t[-1] == "z" and len(set(got[0].t)) == 17  # 16 stretches and the line end


def test_languages_of_long_texts_are_learnt(spark):
    rows = [(i, (ENGLISH if i % 2 else FRENCH) * 2000, "en" if i % 2 else "fr") for i in range(20)]
    rows += [(100, ENGLISH, None), (101, FRENCH * 5, None), (102, "123 !", None), (103, None, None), (104, "", "xx"), (105, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.fit(docs)
    assert m.languages == ["en", "fr"]
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, m, ["doc_id"]).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:20]) and (got[100], got[101], got[102], got[103]) == ("en", "fr", "und", "und")


def test_a_rare_language_is_in_the_sample(spark):
    rows = [(i, f"{ENGLISH}{i}", "en") for i in range(500)] + [(1000 + i, f"{FRENCH}{i}", "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = bounded_sample(docs, 20, 1000, "lang").collect()
    assert sum(r.lang == "en" for r in got) == 20 and sum(r.lang == "fr" for r in got) == 3


def test_long_texts_train_the_classifiers(spark):
    good, bad = ["calm words of a careful page " * 4000 + "\n"] * 4, ["### $$$ %%% @@@ " * 8000 + "\n"] * 4
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in Q.classify(docs, Q.fit(docs, labels), ["doc_id"]).collect()}
    assert min(scores[i] for i in range(4)) > max(scores[i] for i in range(4, 8))
    assert R.fit(docs, labels).trained


def test_quality_scores_are_the_mean_of_learned_buckets():
    rng = random.Random(2)
    p = Q.QualityParams(buckets=1 << 10, epochs=2)
    texts = [" ".join(rng.choice("ab bc cd de é".split()) for _ in range(rng.randrange(30))) for _ in range(40)] + ["", "x"]
    m = Q.train(texts, [i % 2 for i in range(len(texts))], p)
    got = np.concatenate([Q.score_chunk(c, m) for c in A.chunks(pa.array(texts))])
    for text, score in zip(texts, got, strict=True):
        own = next(A.chunks(pa.array([text])))
        buckets = np.concatenate([b[f[0] : f[1]] for b, f in Q.features(own, p)])
        words = text.encode().split()
        grams = sum(max(0, len(text.encode()) - n + 1) for n in p.ngrams)
        assert len(buckets) == len(words) + max(0, len(words) - 1) + grams
        z = sum(float(m.table[b]) for b in buckets) / max(1, len(buckets)) + m.bias
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_language_scores_by_loops():
    rng = random.Random(3)
    p = L.LanguageParams(window=24, filters=3, dim=2, epochs=1)
    texts = [rng.choice((ENGLISH, FRENCH)) * rng.randrange(1, 4) + "x" * rng.randrange(9) for _ in range(12)]
    m = L.train(texts, ["en" if t.startswith("the") else "fr" for t in texts], p)
    w = {k: v.astype(float) for k, v in m.weights.items()}
    best, score = L.score_chunk(next(A.chunks(pa.array(texts))), m)
    for t, b, s in zip(texts, best, score, strict=True):
        data, total = t.encode(), np.zeros(2)
        for at in range(0, len(data), p.window):
            own = data[at : at + p.window]
            x = w["embed"][np.frombuffer(own.ljust(p.window, b"\0"), np.uint8)]
            pooled = []
            for k in p.widths:
                z = [x[i : i + k].ravel() @ w[f"filter{k}"] + w[f"bias{k}"] for i in range(p.window - k + 1)]
                pooled += [max(0.0, max(v[f] for v in z)) for f in range(p.filters)]
            z = np.array(pooled) @ w["out"] + w["out_bias"]
            total += (z - np.log(np.exp(z).sum())) * len(own)
        total /= len(data)
        e = np.exp(total - total.max())
        assert b == total.argmax() and s == pytest.approx((e / e.sum()).max(), abs=1e-5)


@pytest.mark.parametrize("split", [False, True])
def test_remembered_counts_are_bounded_and_used(split):
    from lattica.llm.token_counts import CountParams, PartCounter

    asked = []
    counter = PartCounter(lambda texts: asked.extend(texts) or [len(t) for t in texts], split, CountParams(remembered=5))
    for k in range(300):
        assert counter([f"x{k}", f"x{k}", f"x{k}"]) == [len(f"x{k}")] * 3
        assert len(counter.known) <= 5 + 3
    counter = PartCounter(lambda texts: asked.extend(texts) or [len(t) for t in texts], split, CountParams(remembered=5))
    assert counter(["again"]) == counter(["again"]) == [5] and asked.count("again") == 1


def test_samples_are_full_and_hold_few_rows(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' ELSE concat('t', id) END AS text", "CASE WHEN id < 50 THEN 'x' ELSE 'y' END AS lang")
    got = bounded_sample(docs, 300, 1000, "lang").collect()
    assert sum(r.lang == "y" for r in got) == 300 and sum(r.lang == "x" for r in got) == 33 and all(r.text for r in got)
    assert len(bounded_sample(docs, 300, 1000).collect()) == 300
    one = spark.createDataFrame([(5, "")] * 20_000 + [(7, "word")], "doc_id long, text string")
    assert [r.text for r in bounded_sample(one, 1, 10).collect()] == ["word"]


def test_language_model_starts_from_all_documents(spark):
    """The table that the states start from counts every token of every training document."""
    from lattica.llm import language_model as L

    docs = spark.createDataFrame([(i, f"w{i} and w{i % 7} then w{i % 3}") for i in range(900)], "doc_id long, text string")
    model, _ = L.fit(docs, L.LMParams(own_classes=50, suffix_classes=32))
    assert L.count_neighbours(docs, model).sum() == 900 * 5
    assert not [f for f in L.LMParams.__dataclass_fields__ if f.startswith("sample")]
