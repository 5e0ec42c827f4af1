"""Each operator against a brute-force version, an exact round trip or held-out accuracy,
and on rows made to break it."""

import base64
import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import arrays as A
from lattica.llm import byte_bpe, chat_tree, components, decontamination, jaccard_join, language_id, language_model
from lattica.llm import quality_classifier, quality_rules, queries, substring_dedup, token_counts
from lattica.llm.suffix_automaton import SuffixAutomaton

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def story(seed, n, vocabulary=400):
    rng = np.random.RandomState(seed)
    return " ".join(f"w{k}" for k in rng.randint(0, vocabulary, n))


#: Nulls in every column, empty and long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, " \t\n ", "en", "s", 4), (4, "a", "fr", "s", 1), (5, "a", "fr", "s", 1), (5, "a", "fr", "s", 1),
    (None, story(1, 80), "en", "s", 1), (6, story(1, 80), None, "s", 1), (7, story(1, 80) + " end", "en", "s", 1),
    (8, story(2, 30000, 50), "en", "s", 1), (9, "Ünïcode “quotes” 　 emoji 😀 \x1c\x85 é", "de", "s", 1), (10, "12345 !!! ###", "de", "s", 1),
    (11, "\n".join(["same line"] * 40), "en", "s", 1), (12, "x" * 3000, "en", "s", 1), (13, story(3, 49), "en", "s", 1), (14, story(3, 49) + " more", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def extra(odd):
    """Columns whose names operators use themselves."""
    for c in ("score", "n_words", "node", "ids", "at", "hash", "words", "_text"):
        odd = odd.withColumn(c, F.lit(1))
    return odd


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, db, name):
    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))

    assert rows(queries.queries()[name](spark, sf_dir).toPandas()) == rows(db.execute(queries.oracle_sql()[name]).df())


def test_words_and_hashes():
    texts = [t[1] or "" for t in ODD]
    seen = {}
    for c in A.chunks(pa.array(texts), 64):
        w = A.words(c)
        h = A.word_hashes(c.buf, w)
        for i in range(c.n):
            own = [c.buf[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
            assert own == words(texts[c.rows.start + i])
            for x, y in zip(own, h[w.first[i] : w.first[i + 1]]):
                assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


# 1


def test_quality_learns_and_defines_odd_cases(spark, odd, none, extra):
    good, bad = [story(k, 60) for k in range(40)], ["%%% ".join(story(k, 60).split()) for k in range(40)]
    m = quality_classifier.train([*good[:30], *bad[:30]], [1] * 30 + [0] * 30)
    s = np.concatenate([quality_classifier.score_chunk(c, m) for c in A.chunks(pa.array([*good[30:], *bad[30:]]))])
    assert (s[:10] > 0.5).all() and (s[10:] < 0.5).all()
    for docs in (odd, extra):
        out = quality_classifier.classify(docs, m, ["doc_id"]).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_classifier.classify(none, m, ["doc_id"]).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(odd, labels).bias == 0
    one = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(odd, one).bias > 0


def test_quality_training_skips_what_does_not_fit(monkeypatch):
    seen = []
    bags = quality_classifier._bags
    monkeypatch.setattr(quality_classifier, "_bags", lambda texts, p: seen.extend(texts) or bags(texts, p))
    texts = ["long text " * 30, "a short good text", "a short bad text", "another good text"]
    quality_classifier.train(texts, [1, 1, 0, 1], quality_classifier.QualityParams(max_training_bytes=60, epochs=1))
    assert seen == texts[1:]


# 2


def brute_dedup(docs):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup(spark, none, extra):
    docs = [(r[0], r[1]) for r in ODD if r[0] is not None]
    shared = story(9, 70)
    docs += [(20 + k, f"{story(30 + k, 20 + k)} {shared} {story(60 + k, 25)}") for k in range(12)]
    docs += [(40, shared + " " + shared), (41, story(9, 60)), (42, "he " * 120), (43, "he " * 80 + "ho")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in substring_dedup.deduplicate(df, ["doc_id"]).collect())
    assert got == sorted(brute_dedup(docs))
    assert substring_dedup.deduplicate(none, ["doc_id"]).count() == 0
    out = substring_dedup.deduplicate(extra, ["doc_id"]).collect()
    assert len(out) == len(ODD) and all(r.n_removed == 0 for r in out if r.doc_id is None)
    cleaned = {r.doc_id: r.text for r in substring_dedup.clean_texts(df, substring_dedup.repeated_spans(df)).collect()}
    want = {i: kept for i, n, gone, kept in brute_dedup(docs) if gone}
    assert all((words(cleaned[i]) if kept else cleaned[i]) == (words(kept) if kept else None) for i, kept in want.items())


def test_substring_dedup_of_rows_that_share_a_doc_id(spark):
    a, other = story(70, 60), story(71, 60)
    docs = [(1, a), (2, a + " tail"), (2, other), (2, "short one"), (3, other + " " + a), (3, other + " " + a)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in substring_dedup.deduplicate(df, ["doc_id"]).collect())
    assert got == sorted(brute_dedup(docs))
    cleaned = substring_dedup.clean_texts(df, substring_dedup.repeated_spans(df)).collect()
    assert sorted((r.doc_id, r.text or "") for r in cleaned) == sorted((i, kept) for i, _, _, kept in brute_dedup(docs))


def test_automaton_of_several_references():
    automaton = SuffixAutomaton([b"a", b"b"])
    automaton.extend([b"b", b"c"])
    assert automaton.matching_statistics([b"a", b"b", b"b", b"c", b"a", b"b"]).tolist() == [1, 2, 1, 2, 1, 2]


def test_matching_statistics():
    rng = np.random.RandomState(0)
    ref, query = [bytes([x]) for x in rng.randint(65, 68, 80)], [bytes([x]) for x in rng.randint(65, 68, 60)]
    text = b"".join(ref)
    for i, n in enumerate(SuffixAutomaton(ref).matching_statistics(query)):
        best = next(k for k in range(i + 1, -1, -1) if b"".join(query[i + 1 - k : i + 1]) in text)
        assert n == best


# 3


def test_quality_rules(spark, odd, none, extra):
    good, bad = ["\n".join(story(k * 9 + j, 12) + "." for j in range(8)) for k in range(20)], ["\n".join("### " * 12 for _ in range(8))] * 20
    texts = [*good, *bad]
    chunk = next(A.chunks(pa.array(texts), 1 << 40))
    lines = quality_rules.describe(chunk)[1]
    m = quality_rules.train(lines, np.repeat([1] * 20 + [0] * 20, np.diff(lines.first)))
    share = quality_rules.content_share(lines, m)
    assert (share[:20] == 1).all() and (share[20:] == 0).all()
    for docs in (odd, extra):
        out = quality_rules.apply_rules(docs, m, ["doc_id"]).collect()
        assert len(out) == len(ODD)
        by = {r[0]: r[1] for r in ODD}
        for r in out:
            t = by[r.doc_id] or ""
            w = words(t)
            seen, dup = set(), 0
            for line in t.split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            grams = collections.Counter(zip(w, w[1:], w[2:]))
            rep = [any(grams[tuple(w[j : j + 3])] > 1 for j in range(max(0, k - 2), min(k, len(w) - 3) + 1)) for k in range(len(w))]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
                len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(rep))
            assert r.base_failed == (len(w) < 50 or 100 * sum(rep) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.apply_rules(none, m, ["doc_id"]).count() == 0
    empty = quality_rules.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not empty.trained


def test_quality_rules_label_lines(spark):
    text_line, shout = [" ".join(story(k, 12).split()) + "." for k in range(400)], "### *** " * 8
    good = ["\n".join(text_line[k * 10 : k * 10 + 10]) for k in range(20)]
    bad = ["\n".join([text_line[200 + k], *[shout] * 8, text_line[300 + k]]) for k in range(20)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    m = quality_rules.fit(docs, labels)
    mixed = "\n".join([*text_line[380:385], *[shout] * 5, *text_line[385:390]])
    lines = quality_rules.describe(next(A.chunks(pa.array([mixed]))))[1]
    assert quality_rules.decode(lines, m).tolist() == [1] * 5 + [0] * 5 + [1] * 5
    more = docs.union(spark.createDataFrame([(100, mixed), (101, "\n".join([*text_line[380:382], *[shout] * 20]))], docs.schema))
    e = {r.doc_id: r for r in quality_rules.apply_rules(more, m, ["doc_id"]).collect()}
    for r in more.collect():  # kept, by every labelling of the lines in turn where there are few, else by one step at a time
        x = quality_rules.describe(next(A.chunks(pa.array([r.text]))))[1]
        unary = x.features @ m.weights
        best = {y: (unary[0, y] + m.start[y], [y]) for y in (0, 1)}
        for row in unary[1:]:
            best = {y: max(((v + m.step[z, y] + row[y], [*way, y]) for z, (v, way) in best.items()), key=lambda o: o[0]) for y in (0, 1)}
        way = np.array(max(best.values(), key=lambda o: o[0])[1])
        share = x.words[way == 1].sum() / x.words.sum()
        assert e[r.doc_id].content_share == share and e[r.doc_id].kept == (share >= 0.5 and not e[r.doc_id].base_failed)


def test_viterbi_is_the_best_labelling():
    rng = np.random.RandomState(1)
    p = quality_rules.RuleParams()
    m = quality_rules.LineModel(p, rng.randn(quality_rules.N_FEATURES, 2), rng.randn(2), rng.randn(2, 2), True)
    x = (rng.rand(9, quality_rules.N_FEATURES) < 0.3).astype(np.float32)
    lines = quality_rules.Lines(np.array([0, 4, 4, 9]), np.ones(9, np.int64), x)
    got = quality_rules.decode(lines, m)
    for a, b in ((0, 4), (4, 9)):
        def score(y):
            e = x[a:b] @ m.weights
            return m.start[y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(m.step[u, v] for u, v in zip(y, y[1:]))

        best = max((tuple(map(int, f"{k:0{b - a}b}")) for k in range(2 ** (b - a))), key=score)
        assert tuple(got[a:b]) == best


# 4


def brute_classes(docs, percent=75):
    sets = []
    for _, t in docs:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


@pytest.mark.parametrize("p", [jaccard_join.JaccardParams(), jaccard_join.JaccardParams(frequent=2, deviations=0, pairwise=3, sketched=7, block=8, turns=1)])
def test_jaccard_classes(spark, none, extra, p):
    docs = [(r[0], r[1]) for r in ODD if r[0] is not None]
    rng = np.random.RandomState(5)
    for family in range(4):
        base = story(100 + family, 40 + 40 * family).split()
        for k in range(14):
            own = list(base)
            for at in rng.randint(0, len(own), rng.randint(0, 4 + family)):
                own[at] = f"z{rng.randint(1000)}"
            docs.append((100 + 20 * family + k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_classes(df, p).collect())
    assert got == brute_classes(docs)
    if p.frequent > 2:
        assert jaccard_join.similarity_classes(none.select("doc_id", "text"), p).count() == 0
        assert jaccard_join.similarity_classes(extra, p).count() == len(ODD)


def test_linked_sets_share_an_index_entry():
    p = jaccard_join.JaccardParams()
    rng = np.random.RandomState(2)
    ranks = [(rng.rand(1 << p.count_bits) < share).astype(np.uint8) * 3 for share in (0.7, 0.62, 0.1, 0.0)]
    for n in [2, 3, 5, 12, 13, 16, 17, 40, 63, 65, 200, 500, 1100]:
        for k in range(20):
            rank = ranks[k % 4]
            x = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64))
            y = x[rng.permutation(len(x))[: jaccard_join.least_overlap(len(x), p)]]
            add = (len(y) * 100 // p.percent) - len(x)
            y = np.unique(np.concatenate([y, rng.randint(0, 1 << 62, max(0, add)).astype(np.uint64)]))
            same = len(np.intersect1d(x, y))
            if 100 * same >= p.percent * (len(x) + len(y) - same) and len(x) > 1 and len(y) > 1 and set(x) != set(y):
                (a, least_a), (b, least_b) = jaccard_join.signatures(x, rank, p), jaccard_join.signatures(y, rank, p)
                assert np.intersect1d(a, b).size >= max(least_a, least_b)
                assert jaccard_join.may_link(*(np.frombuffer(jaccard_join._sketch(s), np.uint16) for s in (x, y)), len(x), len(y), p)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (40, 40)], "a long, b long")
    got = {r.node: r.comp for r in components.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}


# 5


def test_language_id(spark, odd, none, extra):
    rng = np.random.RandomState(0)

    def text(syllables):
        return " ".join("".join(rng.choice(syllables, rng.randint(1, 4))) for _ in range(60))

    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "öt"]}
    rows = [(text(v), k) for k, v in kinds.items() for _ in range(40)]
    m = language_id.train([r[0] for r in rows], [r[1] for r in rows])
    best, score = language_id.score_chunk(next(A.chunks(pa.array([text(kinds["aa"]), text(kinds["bb"])]))), m)
    assert [m.languages[k] for k in best] == ["aa", "bb"] and (score > 0.5).all()
    for docs in (odd, extra):
        out = {r.doc_id: r for r in language_id.identify(docs, m, ["doc_id"]).collect()}
        assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (1, 2, 3, 10)) and out[9].lang_pred != "und"
    assert language_id.identify(none, m, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit(none), ["doc_id"]).collect()} == {"und"}
    column = odd.select("doc_id", language_id.prediction(spark, F.col("text"), m).alias("p")).collect()
    assert len(column) == len(ODD)


def test_language_gradients():
    p = language_id.LanguageParams(window=16, filters=3, dim=2)
    m = language_id.train(["abc abd " * 5, "xyz xyw " * 5], ["a", "b"], p)
    x, y = np.frombuffer(b"abcdabcdabcdabcdxyzwxyzwxyzwxyzw", np.uint8).reshape(2, 16), np.array([0, 1])
    w = {k: v.astype(float) for k, v in m.weights.items()}

    def loss():
        z = language_id._forward(x, w, p) @ w["out"] + w["out_bias"]
        return float((np.log(np.exp(z).sum(axis=1)) - z[[0, 1], y]).mean())

    grads = language_id._gradients(x, y, w, p)
    for k, g in grads.items():
        at = tuple(int(v) for v in np.unravel_index(int(np.abs(g).argmax()), g.shape))
        was = w[k][at]
        w[k][at] = was + 1e-5
        up = loss()
        w[k][at] = was - 1e-5
        down = loss()
        w[k][at] = was
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


# 6


def test_decontamination(spark, odd, none, extra):
    item = "Alice bought 12 kg of apples and Bob bought 7 kg of pears so how many kg did Alice and Bob buy in total"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item), (4, item)], "item_id long, text string")
    again = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "30").replace("7", "4")
    mixed = item.replace("Alice", "Carol", 1)  # one value stands for two
    docs = spark.createDataFrame(
        [(1, story(1, 30) + " " + item + " " + story(2, 30)), (2, again), (3, mixed), (4, story(3, 90)), (5, item.split(" so ")[1]), (None, item), (6, None), (1, item)],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert (1, 1) in got and (2, 1) in got and {d for d, _ in got} <= {1, 2, 5}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.contaminated(extra, bench).count() == 0
    few = decontamination.TemplateParams(broadcast_windows=0)
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, few).collect()} == got


def test_decontamination_whatever_the_case(spark):
    item = "Alice Miller met Bob Stone near Lake Como where Carla Weiss and David Brown sold 12 kg of Fuji apples to Erik Holm"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("Alice Miller", "Nora Quist").replace("12", "30")
    docs = spark.createDataFrame(
        [(1, item), (2, story(1, 30) + " " + item.upper()), (3, item.lower() + " " + story(2, 30)), (4, item.title()), (5, other),
         (6, story(4, 90).upper()), (7, "ALICE MILLER MET BOB STONE NEAR LAKE COMO " + story(5, 40))],
        "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.n_matched) for r in decontamination.contaminated(docs, bench).collect()}
    n = len(item.split()) - 7
    assert got == {d: (n, n) for d in (1, 2, 3, 4, 5)}


# 7


def test_chat_tree(spark):
    control = "<|im_end|><|im_start|>assistant ok\\ <\\|"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", control), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 1, None, None), (3, 0, "a\nb", ""),
            (4, 0, "user", "hi"), (4, 1, "assistant", control), (None, 0, "user", "x"), (5, None, "user", "first"), (5, 0, "assistant", "é😀"), (5, 0, "assistant", "é😀")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = chat_tree.paths(turns.withColumn("leaf", F.lit(1)).withColumn("tokens", F.lit(2)))
    for p in (chat_tree.ChatParams(), chat_tree.ChatParams(pack_chars=20)):
        packs = chat_tree.pack(conversations, p)
        out = {r.conv_id: r for r in chat_tree.members(conversations).join(chat_tree.read_back(packs), "leaf").collect()}
        assert set(out) == {1, 2, 3, 4, 5, None}
        for i, r in out.items():
            own = sorted(((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == i))
            assert r.n_turns == len(own)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{x}\n" for _, _, ro, x in own).encode()).hexdigest()
            said = "".join(x for _, _, ro, x in own if ro == "assistant")
            assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
            assert r.formatted_chars == sum(len(chat_tree.format_turn(ro, x)) for _, _, ro, x in own)
    for pack in chat_tree.pack(conversations).collect():
        for n in pack.nodes:
            chain = sum(x.end - x.start for x in n.attends)
            assert chain == n.position and all(x.end <= n.start for x in n.attends)
    both = [p for p in chat_tree.pack(conversations).collect() if "yo" in p.tokens]
    assert sum(p.tokens.count("user\nhi") for p in both) == 1  # a shared turn once
    none = spark.createDataFrame([], turns.schema)
    assert chat_tree.pack(chat_tree.paths(none)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\\\<|\n", "<<||", "a\\nb", "<|im_start|>"])
def test_chat_escapes(text):
    assert chat_tree.unescape(chat_tree.escape(text)) == text and "<|" not in chat_tree.escape(text)
    assert chat_tree.unescape_role(chat_tree.escape_role(text)) == text and "\n" not in chat_tree.escape_role(text)


# 8 and 9


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers")


def test_byte_bpe(spark, odd, none, extra, vocabularies):
    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by = {r[0]: r[1] or "" for r in ODD}
    for docs, p in ((odd, byte_bpe.BpeParams()), (extra, byte_bpe.BpeParams(distinct_bytes=3, fold_bytes=4))):
        out = byte_bpe.encode(docs.coalesce(1), path, vocabularies.PATTERN, ["doc_id"], p).collect()
        assert len(out) == len(ODD)
        for r in out:
            ids = library.encode_ordinary(by[r.doc_id])
            assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes() and bytes(r.decoded).decode() == by[r.doc_id]
    assert byte_bpe.encode(none, path, vocabularies.PATTERN, ["doc_id"]).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(odd, none, extra, vocabularies, name):
    path = vocabularies.path(name)
    by = {r[0]: r[1] or "" for r in ODD}
    if name.endswith("json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    for docs, p in ((odd, token_counts.CountParams()), (extra, token_counts.CountParams(batch_bytes=50, remembered=5, remembered_chars=3))):
        out = token_counts.count_tokens(docs, path, ["doc_id"], p).collect()
        assert len(out) == len(ODD)
        for r in out:
            assert (r.n_bytes, r.n_tokens) == (len(by[r.doc_id].encode()), count(by[r.doc_id])) and r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(none, path, ["doc_id"]).count() == 0


def test_special_strings_are_counted_as_the_library_does(vocabularies):
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        own = token_counts.PartCounter(*token_counts.json_counter(f.read()), token_counts.CountParams())
    texts = ["a<|endoftext|> b", "<|endoftext|>", " a  b\n c's don't", "x <|endoftext|>y z"]
    assert own.split and own(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


# 10


def test_language_model(spark, odd, none, extra):
    p = language_model.LMParams(own_classes=50, suffix_classes=16, states=3, passes=1, block_tokens=5000)
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held_out")
    docs = odd.select("doc_id", held, "text")
    m, counts = language_model.fit(docs.where("not held_out"), p)
    out = language_model.score(docs, m, counts, ["doc_id", "held_out"]).collect()
    assert len(out) == len(ODD)
    tokens = [[*words((t or "").translate(LOW)), "\n"] for _, t, *_ in ODD]
    c = collections.Counter()
    for (i, *_), w in zip(ODD, tokens):
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            c.update(w)
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) for (i, *_), w in zip(ODD, tokens)}
    for r in out:
        assert r.train_tokens == n and math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) and r.score < 0
    m0, counts0 = language_model.fit(none, p)
    assert language_model.score(none, m0, counts0, ["doc_id"]).count() == 0
    assert all(r.n_known == 0 for r in language_model.score(extra, m0, counts0, ["doc_id"]).collect())


def test_forward_recursion_is_exact_and_baum_welch_improves():
    p = language_model.LMParams(states=2, suffix_classes=3)
    classes = language_model.WordClasses.of([], 3)
    rng = np.random.RandomState(0)
    step, emit = rng.dirichlet([1, 1], 2), rng.dirichlet([1] * 4, 2).T
    m = language_model.LanguageModel(p, classes, np.array([0.4, 0.6]), step, emit, np.ones(3), 1, 1)
    seqs = [rng.randint(0, 4, k).tolist() for k in (1, 5, 3, 40)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
    lock = language_model.Lockstep(first)
    laid = lock.lay(np.concatenate(seqs).astype(np.int32))
    got = language_model.forward(laid, lock, m)
    for k in range(3):
        total = 0.0
        for code in range(2 ** len(seqs[k])):
            path = [code >> t & 1 for t in range(len(seqs[k]))]
            x = m.start[path[0]] * emit[seqs[k][0], path[0]]
            for t in range(1, len(path)):
                x *= step[path[t - 1], path[t]] * emit[seqs[k][t], path[t]]
            total += x
        assert math.isclose(got[k], math.log(total), rel_tol=1e-9)
    before = got.sum()
    s, t, e, like = language_model.expected_counts(laid, lock, m)
    assert math.isclose(like, before) and math.isclose(e.sum(), len(laid)) and math.isclose(t.sum(), len(laid) - 4)
    m.start, m.step, m.emit = s / s.sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=0)
    assert language_model.forward(laid, lock, m).sum() >= before


def test_pipeline_stages_keep_columns(spark, odd, sf_dir):
    import corpus_pipeline as c

    docs = odd.withColumn("other", F.lit("x"))
    for _, stage in c.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == [*odd.columns, "other"]
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and 4 in ids and 6 in ids and 5 not in ids and 7 not in ids
    assert c.STAGES[-1][1](spark, docs, sf_dir).count() == len(ids)


def test_pipeline_rows_without_or_with_one_doc_id(spark, odd, sf_dir):
    import corpus_pipeline as c

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    own = [story(k, 90, 5000) for k in range(3)]
    rows = [(None, item), (None, item), (7, item), (1, own[0]), (None, own[0]), (None, own[1]), (2, own[1]), (3, own[2]), (3, own[0] + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    unique = dict(c.STAGES)["n-gram Jaccard join"](spark, docs, sf_dir)
    assert sorted((r.doc_id, r.text) for r in unique.collect()) == [(1, own[0]), (2, own[1]), (3, own[2]), (7, item)]
    clean = dict(c.STAGES)["benchmark decontamination"](spark, docs, sf_dir)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(repr, [x for x in rows if x[1] != item]))


def test_pipeline_of_no_documents(spark, none, sf_dir):
    import corpus_pipeline as c

    for _, stage in c.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_sample_is_bounded_and_free_of_order(spark):
    from lattica.llm.tables import bounded_sample

    rows = [(i % 40, "x" * (i % 90)) for i in range(400)] + [(None, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(tuple, bounded_sample(x, 10, 64).collect())) for x in (df, df.repartition(5).orderBy(F.rand())))
    assert a == b and len(a) == 10 and all(0 < len(t) <= 64 for _, t in a)
