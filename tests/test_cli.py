"""The command line from an alignment to its files, as the pipeline's tables have them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import cli
from lattica.options import DEFAULT_LETTERS, Options
from lattica.operators import pipeline
from lattica.sources import fasta, sinks


@pytest.fixture(scope="module")
def alignment(tmp_path_factory):
    """60 sequences of a focus with gaps and small letters, one with a letter that isn't in the alphabet."""
    rng = np.random.RandomState(3)
    letters = np.array(list(DEFAULT_LETTERS[1:6]))
    rows = letters[rng.randint(0, 5, (60, 9))]
    rows[:, 4] = rows[:, 3]
    rows[rng.rand(60, 9) < 0.05] = "-"
    rows[0] = list("ACDEFAcDA")
    rows[7, 2] = "X"
    path = tmp_path_factory.mktemp("cli") / "family.a2m"
    path.write_text("".join(f">{'ID_X/5-13' if k == 0 else f's{k}'}\n{''.join(r[:5])}\n{''.join(r[5:])}\n" for k, r in enumerate(rows)))
    return path


ARGS = ["-le", "16.0", "-lh", "0.01", "-m", "30", "-g", "-f", "ID_X"]


def test_files_of_a_run(spark, alignment, tmp_path, capsys):
    out = {k: str(tmp_path / k) for k in ("couplings", "weights", "parameters", "json")}
    assert cli.main(["-c", out["couplings"], "--save-weights", out["weights"], "-o", out["parameters"], "--json", out["json"], *ARGS, str(alignment)]) == 0
    said = capsys.readouterr().err.splitlines()
    assert len(said[0].split("\t")) == 6 and "converged" in said[-1]
    lines = [x.split(" ") for x in open(out["couplings"]).read().splitlines()]
    # the small letter's site is left out; numbers begin at the region's start
    sites = [5, 6, 7, 8, 9, 10, 12, 13]
    assert [(int(x[0]), int(x[2])) for x in lines] == [(a, b) for k, a in enumerate(sites) for b in sites[k + 1 :]]
    assert {(x[0], x[1]) for x in lines} <= {(str(n), c) for n, c in zip(range(5, 14), "ACDEFAcDA")} and all(len(x) == 6 and x[4] == "0" for x in lines)
    assert max(lines, key=lambda x: float(x[5]))[:3:2] == ["8", "9"]
    weights = open(out["weights"]).read().splitlines()
    assert len(weights) == 60 and weights[7] == "0.0" and all(0 < float(w) <= 1 for k, w in enumerate(weights) if k != 7)
    p = sinks.read_parameters(out["parameters"])
    assert (p.n_seqs, p.n_skipped, p.max_iter, p.letters) == (59, 1, 30, DEFAULT_LETTERS[1:]) and p.focus == "ACDEFADA" and list(p.offsets) == sites
    assert np.allclose(p.neighbors, [1 / float(w) if float(w) else 0 for w in weights], rtol=1e-6)
    assert np.allclose(p.fi.sum(axis=1), 1, atol=1e-5) and np.allclose(p.fij.sum(axis=(1, 2)), 1, atol=1e-5)
    want = pipeline.run(spark, fasta.read_fasta(spark, str(alignment)), Options(lambda_e=16.0, max_iter=30, gap_reduce=True, focus="ID_X")).parameters()
    for a, b in ((p.hi, want.hi), (p.eij, want.eij), (p.fi, want.fi), (p.fij, want.fij)):
        assert np.allclose(a, b, atol=1e-5)
    found = json.load(open(out["json"]))
    assert found["map"] == {"letters": "ACDEFADA", "indices": sites} and len(found["logo"]) == 8
    # nothing but the files that were asked for
    assert sorted(x.name for x in tmp_path.iterdir()) == sorted(out)
    # the same couplings, but for the last digit, from the saved weights
    again = str(tmp_path / "again")
    assert cli.main(["-w", out["weights"], "-c", again, *ARGS, str(alignment)]) == 0
    assert [x[:-1] for x in open(again)] == [x[:-1] for x in open(out["couplings"])]


def test_text_is_ordered_over_many_parts(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = rows.orderBy("k").select(F.concat(F.lit("line "), F.col("k")).alias("value"))
        folder = str(tmp_path / "parts")
        manifest = sinks.write_parts(lines, folder)
        assert manifest["lines"] == 1000 and len(manifest["parts"]) > 2
        back = sinks.read_parts(spark, folder)
        assert back.count() == 1000 and [r.value for r in back.where("part = 0").collect()][:3] == ["line 0", "line 1", "line 2"]
        sinks.write_text(lines, str(tmp_path / "one"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert open(tmp_path / "one").read().splitlines() == [f"line {k}" for k in range(1000)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["one", "parts"]
    (next(x for x in (tmp_path / "parts").iterdir() if x.name.startswith("part-"))).unlink()
    with pytest.raises(Exception):
        sinks.read_parts(spark, folder).count()
    sinks.write_text(lines.where("false"), str(tmp_path / "none"))
    assert open(tmp_path / "none").read() == ""


def test_flags():
    a = cli.parser().parse_args(["--gapignore", "-ee", "--fast", "-a", "_*^", "-t", "-1", "x"])
    o = cli.options(a)
    assert o.gap_reduce and o.two_stage and o.stochastic and o.clusters == 100 and o.letters == "_*^" and o.theta == -1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--no-such-flag", "x"])
