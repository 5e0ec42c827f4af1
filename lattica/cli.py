"""Command line: ``python -m lattica.cli [options] alignment``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lattica.operators import pipeline
from lattica.operators.scores import mixture_cutoff
from lattica.options import Options
from lattica.sources import fasta, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica", description="Pairwise models of aligned sequences.", allow_abbrev=False)
    add = p.add_argument
    add("alignment", help="aligned sequences in FASTA format")
    add("-w", "--weights", metavar="FILE", help="read sequence weights, one per line")
    add("-c", "--couplings", metavar="FILE", help="write coupling scores (text)")
    add("-o", "--output", metavar="FILE", help="write parameters (binary)")
    add("--json", metavar="FILE", help="write the logo and strong couplings (JSON)")
    add("--save-weights", metavar="FILE", help="write sequence weights")
    add("-s", "--scale", type=float, default=1.0, help="weight of a neighbourhood")
    add("-t", "--theta", type=float, default=0.2, help="divergence of a neighbourhood; outside [0, 1]: no reweighting")
    add("-lh", "--lambdah", type=float, default=0.01, help="L2 penalty of fields")
    add("-le", "--lambdae", type=float, default=100.0, help="L2 penalty of couplings")
    add("-lg", "--lambdag", type=float, default=0.0, help="group penalty of couplings")
    add("-ee", "--twostage", action="store_true", help="estimate the couplings' penalties from a first fit")
    add("--fast", action="store_true", help="clustered weights and a stochastic optimizer")
    add("-a", "--alphabet", help="letters, the gap first")
    add("-f", "--focus", help="keep the upper-case sites of the first sequence whose name begins so")
    add("-g", "--gapreduce", "--gapignore", action="store_true", help="leave out the first letter")
    add("-m", "--maxiter", type=int, default=0, help="most iterations; 0: no bound")
    add("-n", "--ncores", default="max", help="threads: a number or max")
    add("--seed", type=int, default=42)
    add("--compat", action="store_true", help="reference behaviour where it differs from the documented maths")
    return p


def options(a: argparse.Namespace) -> Options:
    return Options(
        letters=a.alphabet, focus=a.focus, theta=a.theta, scale=a.scale, lambda_h=a.lambdah, lambda_e=a.lambdae, lambda_group=a.lambdag,
        gap_reduce=a.gapreduce, max_iter=a.maxiter, stochastic=a.fast, clusters=100 if a.fast else 0, two_stage=a.twostage, seed=a.seed,
        compat=a.compat,
    )


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    threads = "*" if a.ncores == "max" else str(max(1, int(a.ncores)))
    spark = SparkSession.builder.master(f"local[{threads}]").appName("lattica").getOrCreate()
    done = pipeline.run(spark, fasta.read_fasta(spark, a.alignment), options(a), a.weights)
    for h in done.model.result.history:
        print("{iteration}\t{seconds:.2f}\t{gradient:.4f}\t{value:.4f}\t{h_norm:.4f}\t{e_norm:.4f}".format(**h), file=sys.stderr)
    print(f"{done.model.result.status.value}: {done.model.result.value:.6f}", file=sys.stderr)
    if a.couplings:
        sinks.write_text(sinks.coupling_lines(done.table()), a.couplings)
    if a.save_weights:
        sinks.write_text(sinks.weight_lines(done.weights), a.save_weights)
    if a.output:
        done.write_parameters(a.output)
    if a.json:
        scores = done.model.scores()
        Path(a.json).write_text(sinks.export_json(done.parameters(), scores, mixture_cutoff(scores).first().cutoff))
    done.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
