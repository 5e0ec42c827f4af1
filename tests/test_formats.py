"""Data sources: FASTA ranges, parameter files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import formats as FM
from lattica.sources import sinks


@pytest.fixture(scope="module")
def sources(spark):
    FM.register(spark)
    return spark


def whole(text):
    """Records by splitting the whole file."""
    out = []
    for r in ("\n" + text).split("\n>")[1:]:
        name, *body = r.split("\n")
        out.append((name.rstrip(), "".join(x.strip() for x in body)))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_every_cut_gives_every_record_once(end, block):
    rng = random.Random(2)
    text = "".join(f">r{k} a>b{end}" + "".join("ACD>"[: rng.randrange(3)] + "EF" * rng.randrange(4) + end for _ in range(rng.randrange(4))) + end * rng.randrange(2) for k in range(12)).rstrip("\r\n")
    data = text.encode()
    want = [(n, s) for n, s in whole(text.replace("\r\n", "\n"))]
    for size in (1, 3, 10, 50, 10_000):
        got = []
        for at in range(0, len(data), size):
            got += [(n, s) for _, n, s in FM.records(lambda a, n: data[a : a + n], at, min(len(data), at + size), len(data), block)]
        assert got == want


def test_fasta_format_in_ranges(sources, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.fa").write_text("".join(f">{k}-{i}\nACDE\nFG\n" for i in range(50)))
    rows = sources.read.format("fasta").option("range_bytes", 64).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20
    got = [(r.name, r.seq) for r in rows.orderBy("file", "position").collect()]
    assert got == [(f"{k}-{i}", "ACDEFG") for k in range(3) for i in range(50)]
    (tmp_path / "bad.fa").write_text("ACD\n>a\nACD\n")
    with pytest.raises(Exception, match="begins with"):
        sources.read.format("fasta").load(str(tmp_path / "bad.fa")).collect()


def test_parameters_round_trip(sources, tmp_path):
    rng = np.random.RandomState(1)
    n, q, rows = 7, 3, 11
    header = FM.Header(n, 9, 2, 50, 0.2, 0.01, 16.0, 0.0, 8.5, "AC*", "ACAC*CA", tuple(range(3, 3 + n)))
    fi, hi = rng.rand(n, q), rng.randn(n, q)
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    fij, eij = rng.rand(len(pairs), q, q), rng.randn(len(pairs), q, q)
    neighbors = sources.createDataFrame([(s, float(s) / 2) for s in range(rows)], "s bigint, n double").repartition(3)
    fields = sources.createDataFrame([(i + 1, a, float(fi[i, a]), float(hi[i, a])) for i in range(n) for a in range(q)], "i int, a int, f double, h double").repartition(2)
    couplings = sources.createDataFrame(
        [(i, j, a, b, float(fij[k, a, b]), float(eij[k, a, b])) for k, (i, j) in enumerate(pairs) for a in range(q) for b in range(q)],
        "i int, j int, a int, b int, f double, e double").repartition(4)
    path = str(tmp_path / "model.bin")
    FM.write_parameters(header, neighbors, fields, couplings, path)
    assert [p.name for p in tmp_path.iterdir()] == ["model.bin"]
    # as the plain reader of the whole file sees it
    p = sinks.read_parameters(path)
    assert (p.letters, p.focus, p.n_seqs, p.n_skipped, p.max_iter) == ("AC*", "ACAC*CA", 9, 2, 50) and list(p.offsets) == list(header.offsets)
    assert np.allclose(p.neighbors, np.arange(rows) / 2)
    for got, want in ((p.fi, fi), (p.hi, hi), (p.fij, fij), (p.eij, eij)):
        assert np.allclose(got, want, atol=1e-6)
    # and by the source, a few pairs to a task
    read = lambda t: sources.read.format("pair_parameters").option("table", t).option("range_bytes", 100).load(path)
    back = {(r.i, r.j, r.a, r.b): (r.f, r.e) for r in read("couplings").collect()}
    assert read("couplings").rdd.getNumPartitions() > 5 and len(back) == len(pairs) * q * q
    assert all(np.allclose(back[i, j, a, b], (fij[k, a, b], eij[k, a, b]), atol=1e-6) for k, (i, j) in enumerate(pairs) for a in range(q) for b in range(q))
    assert all(np.allclose((r.f, r.h), (fi[r.i - 1, r.a], hi[r.i - 1, r.a]), atol=1e-6) for r in read("fields").collect())
    assert [(r.i, r.letter, r.offset) for r in read("sites").orderBy("i").collect()] == [(k + 1, c, k + 3) for k, c in enumerate(header.focus)]
    head = read("header").first()
    assert (head.n_sites, head.n_codes, head.letters, round(head.n_eff, 3)) == (n, q, "AC*", 8.5)
    assert read("neighbors").agg(F.sum("n")).first()[0] == pytest.approx(rows * (rows - 1) / 4)


def test_a_hole_in_the_cells_is_an_error(sources, tmp_path):
    header = FM.Header(2, 1, 0, 0, 0.2, 0.01, 1.0, 0.0, 1.0, "AC", "--", (1, 2))
    neighbors = sources.createDataFrame([(0, 1.0)], "s bigint, n double")
    fields = sources.createDataFrame([(1, 0, 0.5, 0.0), (1, 1, 0.5, 0.0)], "i int, a int, f double, h double")
    couplings = sources.createDataFrame([(1, 2, a, b, 0.25, 0.0) for a in range(2) for b in range(2)], "i int, j int, a int, b int, f double, e double")
    with pytest.raises(Exception, match="missing"):
        FM.write_parameters(header, neighbors, fields, couplings, str(tmp_path / "x"))
