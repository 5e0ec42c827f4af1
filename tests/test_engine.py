"""Alignments written by hand, exact optima, and file round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import alignment as AL
from lattica.operators import model as PM
from lattica.operators import objective as O
from lattica.operators import optimize as OP
from lattica.operators import pipeline
from lattica.operators import scores as S
from lattica.operators import weights as W
from lattica.options import DEFAULT_LETTERS, Options
from lattica.sources import fasta, sinks
from lattica.streaming import counts


def write(tmp_path, text, name="x.fa"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def sequences(spark, *pairs):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(pairs)], "seq_id long, name string, seq string")


def test_fasta_wrapped_lines_and_carriage_returns(spark, tmp_path):
    path = write(tmp_path, ">a x\r\nAC\r\n\r\nDE\r\n>b\r\nACD\r\nE")
    got = fasta.read_fasta(spark, path).orderBy("seq_id").collect()
    assert [(r.seq_id, r.name, r.seq) for r in got] == [(0, "a x", "ACDE"), (1, "b", "ACDE")]
    assert fasta.check_lengths(fasta.read_fasta(spark, path)) == 4


def test_fasta_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        fasta.check_lengths(fasta.read_fasta(spark, write(tmp_path, ">a\nAC\n>b\nA\n")))
    with pytest.raises(Exception, match="begins with"):
        fasta.read_fasta(spark, write(tmp_path, "a\nAC\n>b\nAC\n")).collect()


def test_dots_are_gaps_for_built_in_letters_alone(spark):
    rows = sequences(spark, ("a", "A.-c"))
    assert AL.encoded(rows, Options()).first().codes == [1, 0, 0, 2 - 21]
    assert AL.encoded(rows, Options(letters=DEFAULT_LETTERS)).first().codes == [1, 21, 0, 2 - 21]


def test_rows_with_a_bad_letter_anywhere_go(spark):
    rows = sequences(spark, ("t", "AcD"), ("u", "AxD"), ("v", "ACE"), ("w", "AüD"))
    a = AL.select(rows, Options(focus="t"))
    assert a.sites == [0, 2] and a.focus_letters == ["A", "D"] and a.offsets == [1, 3]
    assert sorted(r.s for r in a.rows.collect()) == [0, 2]
    assert sorted(r.s for r in a.raw.where("not valid").collect()) == [1, 3]


def test_focus_prefix_region_and_invalid_target(spark):
    rows = sequences(spark, ("AB/10-20", "AC"), ("ABC/1-5", "CC"), ("AB", "DD"))
    assert AL.select(rows, Options(focus="AB")).offsets == [10, 11]
    assert AL.select(sequences(spark, ("AB/x-y", "AC")), Options(focus="AB")).offsets == [1, 2]
    bad = AL.select(sequences(spark, ("p", "AC"), ("t", "AB")), Options(focus="t"))
    assert bad.focus_letters == ["A", "C"]
    first = AL.select(sequences(spark, ("t", "AB"), ("p", "AC")), Options(focus="t"))
    assert first.focus_letters is None
    assert AL.select(rows, Options(focus="none")).n_sites == 2


@pytest.mark.parametrize("theta,want", [(-1, [1, 1, 1]), (1.5, [1, 1, 1]), (0, [2, 2, 1]), (0.5, [3, 3, 3]), (1, [3, 3, 3])])
@pytest.mark.parametrize("strategy", ["block", "segments"])
def test_neighbours_count_gaps_and_copies(spark, theta, want, strategy):
    rows = spark.createDataFrame([(0, [0, 1]), (1, [0, 1]), (2, [0, 2])], "s long, codes array<int>")
    got = W.sequence_weights(rows, theta, 3, 2.0, strategy).orderBy("s").collect()
    assert [r.w for r in got] == [2.0 / n for n in want]


def test_weights_file(spark, tmp_path):
    rows = fasta.read_weights(spark, write(tmp_path, "1.0\n0.5\n"), 2).orderBy("seq_id").collect()
    assert [r.weight for r in rows] == [1.0, 0.5]
    with pytest.raises(ValueError):
        fasta.read_weights(spark, write(tmp_path, "1.0\n"), 2)


def random_model(n_sites=4, q=3, rows=30, gaps=False, seed=0):
    rng = np.random.RandomState(seed)
    codes = rng.randint(-1 if gaps else 0, q, (rows, n_sites))
    shape = O.Shape(n_sites, q)
    return codes, rng.rand(rows), shape, rng.randn(shape.n) * 0.3


@pytest.mark.parametrize("gaps", [False, True])
def test_gradient_by_differences(gaps):
    codes, w, shape, x = random_model(gaps=gaps)
    fn = O.LocalObjective(codes, w, shape, np.full(4, 0.1), np.full(6, 0.2), 0.5)
    _, g = fn(x)
    for k in range(0, shape.n, 5):
        d = np.zeros(shape.n)
        d[k] = 1e-5
        assert abs((fn(x + d)[0] - fn(x - d)[0]) / 2e-5 - g[k]) < 1e-5


def test_optimizers_reach_one_minimum():
    codes, w, shape, x = random_model()
    fn = O.LocalObjective(codes, w, shape, np.full(4, 0.1), np.full(6, 0.2))
    found = [OP.lbfgs(fn, x, epsilon=1e-8), OP.lbfgs(fn, x, epsilon=1e-8, search=OP.backtracking_step)]
    assert abs(found[0].value - found[1].value) < 1e-7
    assert OP.lbfgs(fn, found[0].x, epsilon=1e-4).status is OP.Status.ALREADY_MINIMAL
    assert OP.lbfgs(fn, x, max_iter=2).status is OP.Status.MAX_ITERATIONS
    sparse = OP.lbfgs(fn, x, epsilon=1e-6, l1=1.0, l1_from=shape.n_fields)
    assert (sparse.x[shape.n_fields :] == 0).sum() > 0
    near = OP.adam(fn, found[0].x, 50)
    assert near.value < found[0].value + 1


def test_adam_takes_one_step_without_a_limit():
    codes, w, shape, x = random_model()
    fn = O.LocalObjective(codes, w, shape, np.full(4, 0.1), np.full(6, 0.2))
    assert len(OP.adam(fn, x, 0).history) == 1
    assert np.allclose(OP.adam(fn, x, 0, compat=True).x, 0.1 * OP.adam(fn, x, 0).x)


def chain(spark, n=200, sites=8, seed=3):
    """Draws of a chain in which neighbours agree often."""
    rng = np.random.RandomState(seed)
    x = rng.randint(0, 3, (n, sites))
    for k in range(1, sites):
        same = rng.rand(n) < 0.7
        x[same, k] = x[same, k - 1]
    return spark.createDataFrame([(i, str(i), "".join("_*^"[c] for c in r)) for i, r in enumerate(x)], "seq_id long, name string, seq string")


def test_chain_neighbours_score_highest_and_files_round_trip(spark, tmp_path):
    o = Options(letters="_*^", theta=-1, lambda_h=1.0, lambda_e=1.0)
    run = pipeline.run(spark, chain(spark), o)
    top = run.model.scores().orderBy(F.desc("cn")).limit(7).collect()
    assert all(r.j - r.i == 1 for r in top)
    path = str(tmp_path / "c.txt")
    sinks.write_text(sinks.coupling_lines(run.table()), path)
    back = fasta.read_couplings(spark, path).collect()
    want = {(r.i, r.j): r.score for r in run.table().collect()}
    assert len(back) == 28 and all(abs(r.score - want[r.i, r.j]) < 1e-6 and r.zero == 0 and r.a_i == "-" for r in back)
    p = run.parameters()
    sinks.write_parameters(p, str(tmp_path / "p"))
    q = sinks.read_parameters(str(tmp_path / "p"))
    assert q.letters == "_*^" and np.allclose(q.eij, p.eij, atol=1e-6) and np.allclose(q.fij, p.fij, atol=1e-6) and q.n_seqs == 200
    fields, pairs = sinks.parameter_tables(spark, q)
    assert fields.count() == 24 and pairs.count() == 28 * 9
    assert '"couplings"' in sinks.export_json(p, run.model.scores(), 0.1)
    sinks.write_text(sinks.weight_lines(run.weights), str(tmp_path / "w"))
    assert fasta.read_weights(spark, str(tmp_path / "w"), 200).agg(F.sum("weight")).first()[0] == 200


def test_gap_reduced_fit_and_clustered_weights(spark):
    o = Options(letters="_*^", lambda_h=1.0, lambda_e=1.0, gap_reduce=True, clusters=5, max_iter=5)
    run = pipeline.run(spark, chain(spark, 60, 5), o)
    assert run.model.shape.q == 2 and run.model.scores().count() == 10


def test_order_of_rows_and_letters_doesn_t_matter(spark):
    o = Options(letters="_*^", theta=0.2, lambda_h=1.0, lambda_e=1.0, epsilon=1e-6)
    rows = chain(spark, 80, 5)
    a = {(r.i, r.j): r.cn for r in pipeline.run(spark, rows, o).model.scores().collect()}
    turned = rows.withColumn("seq_id", 79 - F.col("seq_id"))
    b = {(r.i, r.j): r.cn for r in pipeline.run(spark, turned, Options(**{**o.__dict__, "letters": "^_*"})).model.scores().collect()}
    assert all(abs(a[k] - b[k]) < 1e-3 for k in a)


def test_mixture_finds_planted_signal():
    rng = np.random.RandomState(0)
    m = S.Mixture(np.concatenate([rng.randn(3000) * 0.1, 1 + rng.rand(30)]))
    cut = m.cutoff(0.99, 2.0)
    assert 0.2 < cut < 1.0
    assert all(b >= a - 1e-9 for a, b in zip(m.likelihoods, m.likelihoods[1:]))


def test_skew_normal_has_mean_zero_and_mass_one():
    x = np.linspace(-3, 3, 60001)
    for width, skew in ((0.2, 0.0), (0.3, 4.0), (0.1, -30.0)):
        f = np.exp(S.log_skew_normal(x, width, skew))
        assert abs(f.sum() * 1e-4 - 1) < 1e-6 and abs((x * f).sum() * 1e-4) < 1e-6


def test_streaming_counts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, [0, 1]), (0.5, [0, 2])], "w double, codes array<int>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = counts.streaming_pair_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.a, r.b): r.n for r in spark.table("pairs").collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.5}


def test_pairs_of_many_sites(spark):
    from lattica.operators.marginals import pairs_of

    codes = list(range(45))
    rows = spark.createDataFrame([(codes,)], "codes array<int>").select(F.explode(pairs_of(F.col("codes"), 45)).alias("p")).select("p.*").collect()
    assert len(rows) == 45 * 44 // 2 and all(r.a == r.i - 1 and r.b == r.j - 1 for r in rows)


def test_draws_are_those_of_the_cumulative_weights(spark):
    rows = spark.createDataFrame([(i, [i], float(i)) for i in range(1, 5)], "s long, codes array<int>, w double")
    got = {r.s: r.times for r in PM.SampleIndex(rows).draw(np.array([0.5, 1.5, 2.5, 9.5])).collect()}
    assert got == {1: 1, 2: 2, 4: 1}


def test_draws_read_the_buckets_that_they_hit(spark):
    rng = np.random.RandomState(0)
    w = rng.rand(500) * (rng.rand(500) < 0.9)
    rows = spark.createDataFrame([(int(k), [int(k)], float(v)) for k, v in enumerate(w)], "s long, codes array<int>, w double").repartition(4)
    index = PM.SampleIndex(rows, bucket_rows=20)
    assert len(index.buckets) >= 25 and np.isclose(index.total, w.sum())
    ends = np.cumsum(w)
    for n in (3, 200):
        points = rng.random_sample(n) * w.sum()
        want = np.bincount(np.searchsorted(ends, points), minlength=500)
        drawn = index.draw(points)
        assert {r.s: r.times for r in drawn.collect()} == {k: c for k, c in enumerate(want) if c}
    few = index.draw(np.array([0.1, 0.2, ends[-1] - 0.1]))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(few.inputFiles()) >= 1
    few.collect()
    scanned = [p for p in few._jdf.queryExecution().executedPlan().collectLeaves().mkString().split("PartitionFilters")]
    assert len(scanned) > 1 and "bucket" in scanned[1]
    assert index.draw(np.array([])).count() == 0
    index.release()
