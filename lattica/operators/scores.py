"""Coupling scores and the summaries made of them. Inputs are tables of the model's size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.optimize import lbfgs
from lattica.operators.weights import numbered
from lattica.sources.stored import Stored


def coupling_norms(couplings: DataFrame, codes: list[int] | None = None) -> DataFrame:
    """(i, j, fn): Frobenius norm of each pair's matrix, over a subset of codes if given."""
    rows = couplings if codes is None else couplings.where(F.col("a").isin(codes) & F.col("b").isin(codes))
    return rows.groupBy("i", "j").agg(F.sqrt(F.sum(F.col("e") * F.col("e"))).alias("fn"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair; a table with codes has them swapped as well."""
    swap = {"i": "j", "j": "i", "a": "b", "b": "a"}
    return pairs.unionByName(pairs.select(*[F.col(swap.get(c, c)).alias(c) for c in pairs.columns]))


def average_product(pairs: DataFrame, value: str, out: str, n_sites: int) -> DataFrame:
    """``pairs`` with ``out`` = value - mean_i * mean_j / mean: the background of both sites taken off."""
    site = mirrored(pairs.select("i", "j", value)).groupBy("i").agg((F.sum(value) / (n_sites - 1)).alias("m"))
    total = pairs.agg(F.avg(value).alias("grand"))
    left, right = site.withColumnRenamed("m", "m_i"), site.select(F.col("i").alias("j"), F.col("m").alias("m_j"))
    both = pairs.join(F.broadcast(left), "i").join(F.broadcast(right), "j").join(F.broadcast(total))
    background = F.when(F.col("grand") == 0, F.lit(0.0)).otherwise(F.col("m_i") * F.col("m_j") / F.col("grand"))
    return both.withColumn(out, F.col(value) - background).drop("m_i", "m_j", "grand")


def apc_scores(norms: DataFrame, n_sites: int) -> DataFrame:
    """(i, j, fn, cn)."""
    return average_product(norms, "fn", "cn", n_sites).select("i", "j", "fn", "cn")


def coupling_table(scores: DataFrame, offsets: list[int], letters: list[str] | None) -> DataFrame:
    """(i, a_i, j, a_j, zero, score) with the sites' outside numbers and letters, '-' without a focus."""
    spark = scores.sparkSession
    sites = spark.createDataFrame(
        [(k + 1, int(o), letters[k] if letters else "-") for k, o in enumerate(offsets)], "site int, offset int, letter string")
    left = sites.select(F.col("site").alias("i"), F.col("offset").alias("o_i"), F.col("letter").alias("a_i"))
    right = sites.select(F.col("site").alias("j"), F.col("offset").alias("o_j"), F.col("letter").alias("a_j"))
    return scores.join(F.broadcast(left), "i").join(F.broadcast(right), "j").select(
        F.col("o_i").alias("i"), "a_i", F.col("o_j").alias("j"), "a_j", F.lit(0).alias("zero"), F.col("cn").alias("score"))


def top_couplings(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("cn"), "i", "j").limit(n)


def coupling_variances(couplings: DataFrame) -> DataFrame:
    """(i, j, v): population variance of each pair's couplings."""
    return couplings.groupBy("i", "j").agg(F.var_pop("e").alias("v"))


def variance_priors(variances: DataFrame, n_sites: int, least: float = 1e-2, most: float = 1e4) -> DataFrame:
    """(i, j, v, excess, lambda): precision of each pair from its variance beyond the background,
    between ``least`` and ``most``; no excess gives ``most``."""
    rows = average_product(variances, "v", "excess", n_sites)
    raw = F.lit(1.0) / (F.lit(2.0) * F.col("excess"))
    lam = F.when(F.col("excess") > 0, F.least(F.greatest(raw, F.lit(least)), F.lit(most))).otherwise(F.lit(most))
    return rows.select("i", "j", "v", "excess", lam.alias("lambda"))


def prior_statistics(priors: DataFrame, least: float = 1e-2, most: float = 1e4) -> DataFrame:
    """One row: mean of the positive precisions, shares that are positive and within bounds, extremes."""
    raw = F.lit(1.0) / (F.lit(2.0) * F.col("excess"))
    positive = F.col("excess") > 0
    return priors.agg(
        F.avg(F.when(positive, raw)).alias("mean_positive"),
        (F.avg(F.when(positive, 1.0).otherwise(0.0)) * 100).alias("percent_positive"),
        (F.avg(F.when(positive & (raw >= least) & (raw <= most), 1.0).otherwise(0.0)) * 100).alias("percent_within"),
        F.min("lambda").alias("least"), F.max("lambda").alias("most"),
    )


def logo(sites: DataFrame, n_codes: int, least: float = 0.01) -> DataFrame:
    """(i, rank, a, bits): letters of a column with f above ``least``, by ascending bits."""
    by = Window.partitionBy("i")
    entropy = F.sum(F.when(F.col("f") > 0, -F.col("f") * F.log2("f")).otherwise(0.0)).over(by)
    rows = sites.withColumn("bits", F.col("f") * (F.log2(F.lit(float(n_codes))) - entropy)).where(F.col("f") > least)
    return rows.select("i", F.row_number().over(by.orderBy("bits", "a")).alias("rank"), "a", "bits")


def score_quantile(scores: DataFrame, column: str, share: float) -> DataFrame:
    """One row (value): the quantile whose k-th least value stands for (k - 0.5) / n, linear between. Values are dealt by ranges
    and get their rank from the sizes of the ranges before; only the one or two around the place are read."""
    ranked = numbered(scores.select(F.col(column).alias("s")).where(F.col(column).isNotNull()))
    n = ranked.count()
    place = min(max(share * n + 0.5, 1.0), float(max(n, 1)))
    weight = F.lit(1.0) - F.abs(F.col("at") + 1 - F.lit(place))
    return ranked.where(weight > 0).agg(F.sum(F.col("s") * weight).alias("value"))


def strong_cells(couplings: DataFrame, scores: DataFrame, cutoff: float, share: float = 0.1) -> DataFrame:
    """(i, j, a, b, e) of pairs whose cn is above ``cutoff``: rows and columns of their matrices that reach ``share`` of the
    largest coupling of the model."""
    top = couplings.agg((F.max(F.abs("e")) * F.lit(share)).alias("least"))
    own = couplings.join(scores.where(F.col("cn") > cutoff).select("i", "j"), ["i", "j"]).join(F.broadcast(top))
    row = F.max(F.abs("e")).over(Window.partitionBy("i", "j", "a"))
    column = F.max(F.abs("e")).over(Window.partitionBy("i", "j", "b"))
    kept = own.withColumn("row", row).withColumn("column", column).where((F.col("row") > F.col("least")) & (F.col("column") > F.col("least")))
    return kept.select("i", "j", "a", "b", "e")


def permuted(couplings: DataFrame, order: list[int]) -> DataFrame:
    """``couplings`` with each code as its place in ``order``."""
    place = F.array(*[F.lit(order.index(c)) for c in range(len(order))])
    return couplings.withColumn("a", F.get(place, F.col("a"))).withColumn("b", F.get(place, F.col("b")))


def score_matrix(scores: DataFrame, column: str, n_sites: int) -> DataFrame:
    """(i, row): the symmetric matrix of a score by its rows, zero on the diagonal."""
    both = mirrored(scores.select("i", "j", F.col(column).alias("x")))
    cells = both.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("cells"))
    return cells.select("i", F.transform(F.sequence(F.lit(1), F.lit(n_sites)), lambda j: F.coalesce(F.try_element_at("cells", j), F.lit(0.0))).alias("row"))


def score_histogram(scores: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal bins from the least score to the largest, empty ones as well. Scores are made once: sums of
    another evaluation may end a bit away, and the least score would be below the first bin."""
    scores = Stored(scores.select(column), "scores").df
    ends = scores.agg(F.min(column).alias("least"), F.max(column).alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col(column) - F.col("least")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = scores.join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(ends))
    every = every.select("bin", (F.col("least") + F.col("bin") * width).alias("lo"), (F.col("least") + (F.col("bin") + 1) * width).alias("hi"))
    return every.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


# Mixture of background and signal --------------------------------------------------------


def _log_phi(z: np.ndarray) -> np.ndarray:
    return -0.5 * z * z - 0.5 * math.log(2 * math.pi)


def _log_cdf(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, also far in the lower tail."""
    out = np.empty_like(z)
    far = z < -8
    out[~far] = np.log(0.5 * np.array([math.erfc(v) for v in (-z[~far] / math.sqrt(2)).tolist()]))
    t = z[far]
    out[far] = _log_phi(t) - np.log(-t) + np.log1p(-1 / t**2 + 3 / t**4)
    return out


def zero_mean_place(width: float, skew: float) -> float:
    """Where a skew-normal density with mean zero has its place."""
    return -width * skew / math.sqrt(1 + skew * skew) * math.sqrt(2 / math.pi)


def log_skew_normal(x: np.ndarray, width: float, skew: float) -> np.ndarray:
    """Of mean zero."""
    z = (x - zero_mean_place(width, skew)) / width
    return math.log(2 / width) + _log_phi(z) + _log_cdf(skew * z)


def log_normal(x: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    out = np.zeros_like(x)
    ok = x > 0
    out[ok] = np.exp(_log_phi((np.log(x[ok]) - mu) / sigma)) / (x[ok] * sigma)
    return out


class Mixture:
    """Skew-normal background of mean zero and log-normal signal, fitted by maximum likelihood to one score per pair of
    sites, by expectation maximisation. Share, mu and sigma have closed forms; width and skew of the background are
    found by minimising their weighted negative log likelihood, so the likelihood never falls."""

    #: Least sigma: a signal of one point would have any likelihood.
    LEAST_SIGMA = 0.02

    def __init__(self, scores: np.ndarray, rounds: int = 200, tolerance: float = 1e-4) -> None:
        x = np.sort(np.asarray(scores, float))
        n = len(x)
        sd = float(x.std(ddof=1)) or 1e-6
        top = float(np.interp(0.99 * n + 0.5, np.arange(1, n + 1), x))
        top = top if top > 0 else abs(float(x[-1])) or 1e-6
        tail = np.log(x[x >= top]) if x[-1] > 0 else np.zeros(1)
        # even shares with the signal at the 99th percentile, and the upper hundredth as the signal: the likelier end stays
        starts = [(0.5, sd, 0.0, math.log(top), 0.1), (0.99, sd, 0.0, float(tail.mean()), max(float(tail.std()), 0.1))]
        self._best(max((self._fitted(x, s, rounds, tolerance) for s in starts), key=lambda r: r[1][-1]))

    def _best(self, found: tuple[tuple, list[float]]) -> None:
        (self.share, self.width, self.skew, self.mu, self.sigma), self.likelihoods = found

    def _fitted(self, x: np.ndarray, start: tuple, rounds: int, tolerance: float) -> tuple[tuple, list[float]]:
        self.share, self.width, self.skew, self.mu, self.sigma = start
        reached = [self.log_likelihood(x)]
        for _ in range(rounds):
            own = 1 - self.posterior(x)
            self.share = float(own.mean())
            rest, logs = (1 - own)[x > 0], np.log(x[x > 0])
            if rest.sum() > 1e-9:
                self.mu = float((rest * logs).sum() / rest.sum())
                self.sigma = max(math.sqrt(float((rest * (logs - self.mu) ** 2).sum() / rest.sum())), self.LEAST_SIGMA)
            self._background(x, own)
            reached.append(self.log_likelihood(x))
            if reached[-1] - reached[-2] <= tolerance:
                break
        return (self.share, self.width, self.skew, self.mu, self.sigma), reached

    def _background(self, x: np.ndarray, own: np.ndarray) -> None:
        """Width (by its logarithm, so that it stays positive) and skew."""
        total = max(float(own.sum()), 1e-12)

        def weighted(p: np.ndarray) -> tuple[float, np.ndarray]:
            width, skew = math.exp(p[0]), float(p[1])
            z = (x - zero_mean_place(width, skew)) / width
            tail = _log_cdf(skew * z)
            mills = np.exp(_log_phi(skew * z) - tail)
            by_width, by_skew = -x / width, math.sqrt(2 / math.pi) * (1 + skew * skew) ** -1.5
            value = -(own * (math.log(2) - p[0] + _log_phi(z) + tail)).sum()
            g0 = (own * (1 + z * by_width - mills * skew * by_width)).sum()
            g1 = (own * (z * by_skew - mills * (skew * by_skew + z))).sum()
            return float(value) / total, np.array([g0, g1]) / total

        # no skew is a stationary point whatever the scores, so both sides of it are tried
        starts = [self.skew] if self.skew else [0.0, 1.0, -1.0]
        found = min((lbfgs(weighted, np.array([math.log(self.width), k]), 100, 1e-8) for k in starts), key=lambda r: r.value)
        self.width, self.skew = math.exp(found.x[0]), float(found.x[1])

    def background(self, x: np.ndarray) -> np.ndarray:
        return self.share * np.exp(log_skew_normal(x, self.width, self.skew))

    def log_likelihood(self, x: np.ndarray) -> float:
        return float(np.log(np.maximum(self.background(x) + (1 - self.share) * log_normal(x, self.mu, self.sigma), 1e-300)).sum())

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Probability that a score is signal."""
        signal = (1 - self.share) * log_normal(x, self.mu, self.sigma)
        return signal / np.maximum(signal + self.background(x), 1e-300)

    def cutoff(self, probability: float = 0.99, top: float | None = None) -> float:
        """The score at which the posterior reaches ``probability``, by bisection; ``top`` where no score does."""
        lo, hi = 0.0, top if top is not None else 50 * self.width
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if self.posterior(np.array([mid]))[0] >= probability else (mid, hi)
        return hi


def mixture_cutoff(scores: DataFrame, column: str = "cn", probability: float = 0.99) -> DataFrame:
    """One row (cutoff, share, n_above). Scores are one per pair of sites: a model's size."""
    x = scores.select(column).toArrow().column(0).to_numpy()
    m = Mixture(x)
    cut = m.cutoff(probability, float(x.max()))
    return scores.sparkSession.createDataFrame([(float(cut), float(1 - m.share), int((x > cut).sum()))], "cutoff double, share double, n_above long")
