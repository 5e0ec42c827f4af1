"""The registered queries and the SQL that checks them.

Tables become alignments by the adapters: ``embeddings`` (all 64 dimensions, 3 codes), all pieces of 24
characters of ``documents`` (29 letters) and ``lineitem`` (6 sites, 11 codes). All queries read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.alphabet import fold_case
from lattica.operators import alignment as AL
from lattica.operators import marginals as M
from lattica.operators import model as PM
from lattica.operators import objective as O
from lattica.operators import scores as S
from lattica.operators import tiled as T
from lattica.operators import weights as W
from lattica.operators.dropout import DropoutObjective
from lattica.options import Options
from lattica.plans.sql import ORACLES
from lattica.sources import adapters

SITES, Q, THETA = 64, 3, 0.4
LAMBDA_H, LAMBDA_E, LAMBDA_GROUP = 0.01, 1.0, 0.5


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def emb(spark, d) -> DataFrame:
    return adapters.embedding_codes(_read(spark, d, "embeddings"), SITES)


def emb_w(spark, d) -> DataFrame:
    rows = emb(spark, d)
    return rows.join(W.sequence_weights(rows, THETA, Q), "s").select("s", "codes", "w").cache()


def li_w(spark, d) -> DataFrame:
    rows = adapters.lineitem_codes(_read(spark, d, "lineitem"))
    return rows.groupBy("codes").agg(F.count(F.lit(1)).cast("double").alias("w"))


def _doc_options(**k) -> Options:
    return Options(letters=adapters.DOCUMENT_LETTERS, **k)


def docs(spark, d) -> DataFrame:
    return adapters.document_pieces(_read(spark, d, "documents"))


def _n_eff(rows) -> float:
    return W.effective_count(rows)


def _kept(table: DataFrame) -> DataFrame:
    """A table of the model's size that later steps read several times, in a partition for each core at most."""
    return table.coalesce(table.sparkSession.sparkContext.defaultParallelism).cache()


def _marginals(spark, d):
    rows = emb_w(spark, d)
    n = _n_eff(rows)
    return rows, _kept(M.site_marginals(rows, SITES, Q, n)), M.pair_marginals(rows, SITES, Q, n), n


def _covariances(spark, d):
    rows, fi, fij, n = _marginals(spark, d)
    return rows, fi, _kept(M.covariances(fi, fij)), n


def _fixed_model(spark, d):
    """Rows, fields and couplings that aren't fitted: initial fields and covariances."""
    rows, fi, e, n = _covariances(spark, d)
    h = M.initial_fields(fi, n)
    return rows, h, e


def _evaluated(rows, h, e, q=Q, lambda_h=0.0, lambda_e=0.0):
    """Value and gradient at given parameters, by tiles; ``e`` None for couplings of zero."""
    layout = T.Layout.of(SITES, q)
    objective = T.TiledObjective(rows, layout, lambda_h)
    points = T.tiles_of(rows.sparkSession, layout, h, None, lambda_e, e)
    found = objective.at(points.withColumn("d", F.lit(None).cast("binary")))
    objective.release()
    return found, layout


def _field_gradient(found, layout):
    return T.field_rows(found.table.df, layout, "g").select("i", "a", _r("h").alias("g"))


def _coupling_gradient(found, layout):
    return T.coupling_rows(found.table.df, layout, "g").select("i", "j", "a", "b", _r("e").alias("g"))


# Encoding and selection

def msa_encode(spark, d):
    rows = AL.encoded(docs(spark, d), _doc_options())
    return rows.select("s.doc_id", "s.piece", F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))).alias("codes"))


def msa_valid_rows(spark, d):
    rows = AL.encoded(docs(spark, d), _doc_options()).where("valid")
    folded = fold_case(F.col("codes"), len(adapters.DOCUMENT_LETTERS))
    return rows.select("s.doc_id", "s.piece", F.concat_ws(",", F.transform(folded, lambda c: c.cast("string"))).alias("codes"))


def msa_skipped_rows(spark, d):
    return AL.encoded(docs(spark, d), _doc_options()).where("not valid").select("s.doc_id", "s.piece")


def alignment_lengths(spark, d):
    return docs(spark, d).agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most"), F.count(F.lit(1)).alias("n"))


def _focus(spark, d):
    return AL.select(docs(spark, d), _doc_options(focus="1", gap_reduce=True))


def focus_columns(spark, d):
    a = _focus(spark, d)
    return spark.createDataFrame([(i + 1, s + 1) for i, s in enumerate(a.sites if a.found else [])], "i int, source_column int")


def focus_offsets(spark, d):
    a = _focus(spark, d)
    if not a.found:
        return spark.createDataFrame([], "i int, offset int, letter string")
    letters = a.focus_letters or ["-"] * a.n_sites
    return spark.createDataFrame([(i + 1, o, x) for i, (o, x) in enumerate(zip(a.offsets, letters, strict=True))], "i int, offset int, letter string")


def lineitem_codes(spark, d):
    rows = adapters.lineitem_codes(_read(spark, d, "lineitem"))
    return rows.groupBy(F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))).alias("codes")).agg(F.count(F.lit(1)).alias("n"))


# Weights

def neighbor_counts(spark, d):
    return W.neighbor_counts(emb(spark, d), THETA, Q)


def neighbor_counts_segments(spark, d):
    return W.neighbor_counts(emb(spark, d), 0.2, Q, strategy="segments")


def neighbor_counts_documents(spark, d):
    a = AL.select(docs(spark, d), _doc_options())
    return W.neighbor_counts(a.rows, 0.2, a.q).select("s.doc_id", "s.piece", "n")


def seq_weights(spark, d):
    return W.sequence_weights(emb(spark, d), THETA, Q, scale=2.0).select("s", _r("w").alias("w"))


def n_eff(spark, d):
    return W.sequence_weights(emb(spark, d), THETA, Q).agg(_r(F.sum("w")).alias("n_eff"))


def weights_realigned(spark, d):
    a = AL.select(docs(spark, d), _doc_options())
    return AL.realigned(a, W.sequence_weights(a.rows, 0.2, a.q)).select("s.doc_id", "s.piece", _r("weight").alias("weight"))


def weights_of_skipped(spark, d):
    a = AL.select(docs(spark, d), _doc_options())
    listed = a.raw.select(F.col("s").alias("seq_id"), F.when((F.col("s.doc_id") + F.col("s.piece")) % 2 == 0, 1.0).otherwise(0.0).alias("weight"))
    return AL.skipped_with_weight(a, listed).select("s.doc_id", "s.piece", "weight")


def _clusters(spark, d):
    rows = emb(spark, d)
    centers = rows.orderBy("s").limit(8).select((F.row_number().over(_by("s")) - 1).alias("cluster"), F.col("codes").alias("center"))
    return rows, centers, W.assign_clusters(rows, centers)


def _by(*c):
    from pyspark.sql import Window

    return Window.orderBy(*c)


def cluster_assign(spark, d):
    return _clusters(spark, d)[2].select("s", "cluster")


def cluster_consensus(spark, d):
    return W.consensus(_clusters(spark, d)[2]).select("cluster", "i", "a", "n")


def cluster_sizes(spark, d):
    from pyspark.sql import Window

    sizes = _clusters(spark, d)[2].groupBy("cluster").count()
    end = F.sum("count").over(Window.orderBy("cluster"))  # as many rows as clusters
    return sizes.select("cluster", F.col("count").alias("n"), (end - F.col("count")).alias("start"), end.alias("end"))


def cluster_neighbors(spark, d):
    _, centers, assigned = _clusters(spark, d)
    return W.clustered_counts(assigned, W.as_centers(W.consensus(assigned)), THETA, SITES)


def fast_weights(spark, d):
    return W.clustered_weights(emb(spark, d), THETA, 100).select("s", _r("w").alias("w"))


# Marginals

def site_marginals(spark, d):
    return _marginals(spark, d)[1].select("i", "a", _r("f").alias("f"))


def pair_marginals(spark, d):
    return _marginals(spark, d)[2].select("i", "j", "a", "b", _r("f").alias("f"))


def site_marginals_li(spark, d):
    return M.site_marginals(li_w(spark, d), 6, 11).select("i", "a", _r("f").alias("f"))


def pair_marginals_li(spark, d):
    return M.pair_marginals(li_w(spark, d), 6, 11).select("i", "j", "a", "b", _r("f").alias("f"))


def _gapped(spark, d):
    return emb_w(spark, d).withColumn("codes", F.transform("codes", lambda c: c - 1))


def site_marginals_gap(spark, d):
    return M.site_marginals_gap(_gapped(spark, d), SITES, Q - 1).select("i", "a", _r("f").alias("f"))


def pair_marginals_gap(spark, d):
    return M.pair_marginals_gap(_gapped(spark, d), SITES, Q - 1).select("i", "j", "a", "b", _r("f").alias("f"))


def init_fields(spark, d):
    _, fi, _, n = _marginals(spark, d)
    return M.initial_fields(fi, n).select("i", "a", _r("h").alias("h"))


def column_information(spark, d):
    return M.column_information(_marginals(spark, d)[1], Q).select("i", _r("entropy").alias("entropy"), _r("information").alias("information"))


def pair_covariances(spark, d):
    return _covariances(spark, d)[2].select("i", "j", "a", "b", _r("e").alias("e"))


# Objective

def _at_start(spark, d, lambda_h=0.0):
    rows, fi, _, n = _marginals(spark, d)
    return _evaluated(rows, M.initial_fields(fi, n), None, lambda_h=lambda_h)


def nll_init(spark, d):
    return spark.createDataFrame([(_at_start(spark, d)[0].value,)], "nll double").select(_r("nll", 4).alias("nll"))


def grad_fields_init(spark, d):
    return _field_gradient(*_at_start(spark, d, LAMBDA_H))


def grad_couplings_init(spark, d):
    return _coupling_gradient(*_at_start(spark, d))


def potentials(spark, d):
    rows, h, e = _fixed_model(spark, d)
    return O.energies(rows, h, e).select("s", "i", "a", _r("energy").alias("energy"))


def site_conditionals(spark, d):
    rows, h, e = _fixed_model(spark, d)
    return O.conditionals(O.energies(rows, h, e)).select("s", "i", "a", _r("p").alias("p"))


def objective_fixed_params(spark, d):
    rows, h, e = _fixed_model(spark, d)
    value = _evaluated(rows, h, e)[0].value
    return O.penalty(h, e, LAMBDA_H, LAMBDA_E).withColumn("nll", F.lit(value)).select(
        _r("nll", 4).alias("nll"), _r("penalty", 4).alias("penalty"), _r(F.col("nll") + F.col("penalty"), 4).alias("objective"))


def _fixed_gradient(spark, d):
    return _evaluated(*_fixed_model(spark, d), lambda_h=LAMBDA_H, lambda_e=LAMBDA_E)


def grad_fixed_fields(spark, d):
    return _field_gradient(*_fixed_gradient(spark, d))


def grad_fixed_couplings(spark, d):
    return _coupling_gradient(*_fixed_gradient(spark, d))


def gradient_norms(spark, d):
    found, layout = _fixed_gradient(spark, d)
    norm = lambda rows, c: rows.agg(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c))
    return norm(T.field_rows(found.table.df, layout, "g"), "h").join(norm(T.coupling_rows(found.table.df, layout, "g"), "e")).select(
        _r("h", 4).alias("h_gradient"), _r("e", 4).alias("e_gradient"))


def _gap_gradient(spark, d, lambda_h=LAMBDA_H, lambda_e=LAMBDA_E):
    rows = _gapped(spark, d)
    fi = M.site_marginals_gap(rows, SITES, Q - 1)
    e = M.covariances(fi, M.pair_marginals_gap(rows, SITES, Q - 1))
    return _evaluated(rows, M.initial_fields(fi, _n_eff(rows)), e, Q - 1, lambda_h, lambda_e)


def objective_gap(spark, d):
    return spark.createDataFrame([(_gap_gradient(spark, d, 0.0, 0.0)[0].value,)], "nll double").select(_r("nll", 4).alias("nll"))


def grad_gap_fields(spark, d):
    return _field_gradient(*_gap_gradient(spark, d))


def grad_gap_couplings(spark, d):
    return _coupling_gradient(*_gap_gradient(spark, d))


def objective_dropout(spark, d):
    """The value where each row keeps half of the parameters, at fixed parameters, for three seeds."""
    rows, h, e = _fixed_model(spark, d)
    layout = T.Layout.of(SITES, Q)
    points = T.tiles_of(spark, layout, h, None, 0.0, e).withColumn("d", F.lit(None).cast("binary"))
    found = []
    for seed in range(3):
        objective = DropoutObjective(rows, layout, 0.0, seed=seed)
        found.append((seed, objective.at(points).value))
        objective.release()
    return spark.createDataFrame(found, "seed int, nll double").select("seed", _r("nll", 4).alias("nll"))


def group_penalty(spark, d):
    return O.group_penalty(_covariances(spark, d)[2], LAMBDA_GROUP).select(_r("penalty").alias("penalty"))


def parameter_norms(spark, d):
    _, h, e = _fixed_model(spark, d)
    return h.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h")).join(
        e.agg(F.sqrt(F.sum(F.col("e") * F.col("e"))).alias("e"), F.max(F.abs("e")).alias("m"))
    ).select(_r("h").alias("h_norm"), _r("e").alias("e_norm"), _r("m").alias("e_max"))


# Scores

def coupling_norms(spark, d):
    return S.coupling_norms(_covariances(spark, d)[2]).select("i", "j", _r("fn").alias("fn"))


def coupling_norms_slice(spark, d):
    return S.coupling_norms(_covariances(spark, d)[2], [1, 2]).select("i", "j", _r("fn").alias("fn"))


def _scores(spark, d):
    return S.apc_scores(S.coupling_norms(_covariances(spark, d)[2]), SITES)


def apc_scores(spark, d):
    return _scores(spark, d).select("i", "j", _r("cn").alias("cn"))


def coupling_table(spark, d):
    table = S.coupling_table(_scores(spark, d), list(range(1, SITES + 1)), None)
    return table.select("i", "a_i", "j", "a_j", "zero", _r("score").alias("score"))


def top_couplings(spark, d):
    return S.top_couplings(_scores(spark, d), 10).select("i", "j", _r("cn").alias("cn"))


def couplings_above(spark, d):
    return _scores(spark, d).where("cn > 0.01").select("i", "j", _r("cn").alias("cn"))


def variance_priors(spark, d):
    return S.variance_priors(S.coupling_variances(_covariances(spark, d)[2]), SITES).select(
        "i", "j", _r("v", 9).alias("v"), _r("lambda", 3).alias("lambda"))


def prior_stats(spark, d):
    p = S.variance_priors(S.coupling_variances(_covariances(spark, d)[2]), SITES)
    return S.prior_statistics(p).select(
        _r(F.log10("mean_positive"), 3).alias("log10_mean_positive"), "percent_positive", "percent_within", _r("least", 3).alias("least"), _r("most", 3).alias("most"))


def logo_bits(spark, d):
    return S.logo(_marginals(spark, d)[1], Q).select("i", "rank", "a", _r("bits").alias("bits"))


def score_stats(spark, d):
    cn = _scores(spark, d)
    return cn.agg(F.stddev_samp("cn").alias("sd"), F.max("cn").alias("top")).join(S.score_quantile(cn, "cn", 0.99)).select(
        _r("sd").alias("sd"), _r("top").alias("top"), _r("value").alias("p99"))


def strong_cells(spark, d):
    e = _covariances(spark, d)[2]
    scores = S.apc_scores(S.coupling_norms(e), SITES)
    return S.strong_cells(e, scores, 0.01, 0.5).select("i", "j", "a", "b", _r("e").alias("e"))


def permuted_couplings(spark, d):
    return S.permuted(_covariances(spark, d)[2], [2, 0, 1]).select("i", "j", "a", "b", _r("e").alias("e"))


def score_matrix(spark, d):
    rows = S.score_matrix(_scores(spark, d), "cn", SITES).select("i", F.posexplode("row").alias("at", "x"))
    return rows.select("i", (F.col("at") + 1).alias("j"), _r("x").alias("cn"))


def score_histogram(spark, d):
    return S.score_histogram(_scores(spark, d), "cn", 20).select("bin", _r("lo").alias("lo"), _r("hi").alias("hi"), "n")


def mixture_cutoff(spark, d):
    return S.mixture_cutoff(_scores(spark, d))


def weighted_sample(spark, d):
    """Rows that 64 evenly spaced points of the cumulative weights fall on."""
    import numpy as np

    rows = emb_w(spark, d)
    points = (np.arange(1, 65) - 0.5) / 64 * _n_eff(rows)
    return PM.SampleIndex(rows).draw(points).select("s", "times")


# Fits

def _fit(spark, d, **k):
    m = PM.fit(emb_w(spark, d), SITES, Q, Options(lambda_h=LAMBDA_H, lambda_e=LAMBDA_E, **k))
    return m.scores().select("i", "j", _r("fn", 3).alias("fn"), _r("cn", 3).alias("cn"))


def fit_lbfgs(spark, d):
    return _fit(spark, d)


def fit_gapreduce(spark, d):
    return _fit(spark, d, gap_reduce=True)


def fit_group(spark, d):
    return _fit(spark, d, lambda_group=LAMBDA_GROUP)


def fit_twostage(spark, d):
    return _fit(spark, d, two_stage=True)


def fit_adam(spark, d):
    return _fit(spark, d, stochastic=True, max_iter=50)


def fit_progress(spark, d):
    m = PM.fit(emb_w(spark, d), SITES, Q, Options(lambda_h=LAMBDA_H, lambda_e=LAMBDA_E))
    return m.progress().select("iteration", "evaluations", *(_r(c, 3).alias(c) for c in ("value", "gradient", "h_norm", "e_norm", "h_gradient", "e_gradient", "step")))


def fit_on_executors(spark, d):
    """To the optimum by tiles, with the default settings."""
    m = PM.fit(emb_w(spark, d), SITES, Q, Options(local_cells=0))
    return m.scores().select("i", "j", _r("fn", 3).alias("fn"), _r("cn", 3).alias("cn"))


_QUERIES = (
    msa_encode, msa_valid_rows, msa_skipped_rows, alignment_lengths, focus_columns, focus_offsets, lineitem_codes,
    neighbor_counts, neighbor_counts_segments, neighbor_counts_documents, seq_weights, n_eff, weights_realigned, weights_of_skipped,
    cluster_assign, cluster_consensus, cluster_sizes, cluster_neighbors, fast_weights,
    site_marginals, pair_marginals, site_marginals_li, pair_marginals_li, site_marginals_gap, pair_marginals_gap, init_fields,
    column_information, pair_covariances, nll_init, grad_fields_init, grad_couplings_init, potentials, site_conditionals,
    objective_fixed_params, grad_fixed_fields, grad_fixed_couplings, objective_gap, grad_gap_fields, grad_gap_couplings, gradient_norms, objective_dropout, group_penalty, parameter_norms,
    coupling_norms, coupling_norms_slice, apc_scores, coupling_table, top_couplings, couplings_above, variance_priors, prior_stats,
    logo_bits, score_stats, strong_cells, permuted_couplings, score_matrix, score_histogram, mixture_cutoff, weighted_sample, fit_lbfgs, fit_gapreduce, fit_group, fit_twostage, fit_adam, fit_progress, fit_on_executors,
)


#: Queries that a second name has had since they read part of their tables only.
_WHOLE = (
    msa_encode, msa_valid_rows, msa_skipped_rows, alignment_lengths, neighbor_counts_documents, neighbor_counts, seq_weights, site_marginals,
    pair_marginals, coupling_table, fit_lbfgs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {f"{f.__name__}_whole": f for f in _WHOLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
