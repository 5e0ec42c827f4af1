"""From an alignment to a model and its files, in the order of the command line."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import alignment as AL
from lattica.operators import scores as S
from lattica.operators import weights as W
from lattica.operators.model import PairModel, fit
from lattica.options import Options
from lattica.sources import fasta, formats, sinks


@dataclass
class Run:
    alignment: AL.Alignment
    weights: DataFrame  # (s, weight) of every raw row
    model: PairModel

    def table(self) -> DataFrame:
        a = self.alignment
        return S.coupling_table(self.model.scores(), a.offsets, a.focus_letters)

    def write_parameters(self, path: str) -> None:
        """The parameter file, from tables; only its header is made on the driver."""
        a, m, o = self.alignment, self.model, self.model.options
        n = m.shape.n_sites
        sites, pairs = m.marginals()
        kept = a.raw.where("valid").count()
        scale = F.lit(1.0 if o.compat else o.scale * o.scale)
        neighbors = self.weights.select("s", F.when(F.col("weight") > 0, scale / (F.col("weight") * F.lit(o.scale))).otherwise(0.0).alias("n"))
        letters = a.letters[1:] if o.gap_reduce else a.letters
        header = formats.Header(
            n, kept, a.raw.count() - kept, o.max_iter, o.theta, o.lambda_h, o.lambda_e, o.lambda_group, m.n_eff, letters,
            "".join(a.focus_letters or [a.letters[0]] * n), tuple(int(x) for x in a.offsets))
        formats.write_parameters(
            header, neighbors, m.fields().join(sites, ["i", "a"]), m.couplings().join(pairs, ["i", "j", "a", "b"]), path)

    def release(self) -> None:
        self.model.release()

    def parameters(self) -> sinks.Parameters:
        a, m, o = self.alignment, self.model, self.model.options
        n, q = m.shape.n_sites, m.shape.q
        sites, pairs = m.marginals()
        fi, fij = np.zeros((n, q)), np.zeros((len(m.shape.i), q, q))
        at = np.zeros((n, n), int)
        at[m.shape.i, m.shape.j] = np.arange(len(m.shape.i))
        for r in sites.toLocalIterator():
            fi[r.i - 1, r.a] = r.f
        for r in pairs.toLocalIterator():
            fij[at[r.i - 1, r.j - 1], r.a, r.b] = r.f
        if len(m.x):
            hi, eij = m.shape.fields(m.x), m.shape.couplings(m.x)
        else:
            hi, eij = np.zeros((n, q)), np.zeros_like(fij)
            for r in m.fields().toLocalIterator():
                hi[r.i - 1, r.a] = r.h
            for r in m.couplings().toLocalIterator():
                eij[at[r.i - 1, r.j - 1], r.a, r.b] = r.e
        n_seqs = a.raw.where("valid").count()
        letters = a.letters[1:] if o.gap_reduce else a.letters
        return sinks.Parameters(
            n_seqs, a.raw.count() - n_seqs, o.max_iter, o.theta, o.lambda_h, o.lambda_e, o.lambda_group, m.n_eff, letters,
            sinks.neighbor_column(self.weights, o.scale, o.compat), "".join(a.focus_letters or [a.letters[0]] * n), np.array(a.offsets),
            fi, hi, fij, eij,
        )


def run(spark: SparkSession, sequences: DataFrame, o: Options = Options(), weights_path: str | None = None) -> Run:
    """``sequences`` is (seq_id, name, seq); weights from a file ignore theta and scale."""
    a = AL.select(sequences, o)
    if weights_path:
        listed = fasta.read_weights(spark, weights_path, a.raw.count())
        for r in AL.skipped_with_weight(a, listed).collect():
            print(f"warning: dropped sequence {r.s} has weight {r.weight}")
        weights = listed.select(F.col("seq_id").alias("s"), F.col("weight").alias("w"))
    elif o.clusters and a.rows.count() > o.clusters:
        weights = W.clustered_weights(a.rows, o.theta, o.clusters, o.scale, seed=o.seed, compat=o.compat)
    else:
        weights = W.sequence_weights(a.rows, o.theta, a.q, o.scale)
    rows = a.rows.join(weights, "s").select("s", "codes", "w").cache()
    return Run(a, AL.realigned(a, rows.select("s", "w")), fit(rows, a.n_sites, a.q, o))
