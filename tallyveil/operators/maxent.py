"""Maximum-entropy distribution over the whole domain, its moments, and a noise-aware fit.

A model is a list of column sets with one parameter per canonical cell. Every possible row falls in at
most one canonical cell per set, so a row is described by the few query ids that are active in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.functions.sqltext import array, ident
from tallyveil.operators.cliquetree import CliqueTree, Statistics, marginals
from tallyveil.operators.domain import Domain, all_rows, rank_text
from tallyveil.operators.factors import log_sum_exp
from tallyveil.operators.marginals import Clique
from tallyveil.session import broadcast_checked, cut_lineage

JITTER = 1e-12  # added to the covariance diagonal
PRIOR_SD = 10.0
MAX_PARAMETERS = 5000  # the parameter covariance is a driver-side matrix; a larger workload raises
WEAK = 4.0  # standard deviations of a count below which its parameter is not drawn from a normal
GRID = 2401  # points of the density of a weak parameter
MAX_MOVE = 3.0  # largest change of a parameter in one step
TOLERANCE = 1e-4  # gain in log density below which a fit stops
CONVERGED = 1e-3  # gain in log density that a further step may promise


@dataclass(frozen=True)
class Model:
    """Column sets, and per set the query id of each cell (-1: none)."""

    domain: Domain
    cliques: tuple[Clique, ...]
    ids: tuple[tuple[int, ...], ...]

    @property
    def size(self) -> int:
        return sum(i >= 0 for q in self.ids for i in q)

    @staticmethod
    def of(domain: Domain, cliques: Sequence[Clique], queries: DataFrame) -> "Model":
        """From the canonical queries (clique_id, cell, query_id)."""
        rows = queries.select("clique_id", "cell", "query_id").limit(MAX_PARAMETERS + 1).collect()
        if len(rows) > MAX_PARAMETERS:
            raise ValueError(f"more than {MAX_PARAMETERS} parameters; use the tree model")
        ids = [[-1] * domain.cells(c) for c in cliques]
        for r in rows:
            ids[r["clique_id"]][r["cell"]] = r["query_id"]
        return Model(domain, tuple(cliques), tuple(tuple(i) for i in ids))

    def active(self) -> Column:
        """Query ids a row of codes is counted in: one lookup per column set, no join."""
        hits = [f"get({array([None if v < 0 else v for v in i])}, int({rank_text(c, self.domain.sizes(c))}))" for c, i in zip(self.cliques, self.ids)]
        return F.expr(f"array_compact(array({', '.join(hits)}))")


def log_weight(active: str, lambdas: Sequence[float]) -> Column:
    """Sum of the parameters of the active queries."""
    return F.expr(f"aggregate({ident(active)}, 0D, (acc, q) -> acc + get({array([float(v) for v in lambdas])}, q))")


def domain_rows(spark: SparkSession, model: Model) -> DataFrame:
    """Every possible row with its active queries."""
    return all_rows(spark, model.domain).withColumn("active", model.active())


def statistic_cache(rows: DataFrame) -> DataFrame:
    """Distinct statistic vectors with how many rows share them: (active, rows)."""
    return rows.groupBy("active").agg(F.count("*").alias("rows"))


def lambda0(cache: DataFrame, lambdas: Sequence[float]) -> float:
    """Log normaliser."""
    weighted = cache.select((log_weight("active", lambdas) + F.ln("rows")).alias("logw"))
    return log_sum_exp(weighted, []).first()[0]


def statistic_mean(cache: DataFrame, lambdas: Sequence[float], norm: float | None = None) -> DataFrame:
    """(query_id, mean)."""
    z = lambda0(cache, lambdas) if norm is None else norm
    p = F.exp(log_weight("active", lambdas) + F.ln("rows") - F.lit(z))
    return cache.select(p.alias("p"), F.explode("active").alias("query_id")).groupBy("query_id").agg(F.sum("p").alias("mean"))


def _second_moments(cache: DataFrame, lambdas: Sequence[float], z: float, size: int) -> DataFrame:
    """(i, j, value): model expectation of the product of statistics i and j; i = j = size is the total mass.

    Each Arrow batch is reduced to one matrix, so nothing but d*d sums is shuffled.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mass = np.zeros((size, size)), 0.0
        for b in batches:
            if not len(b):
                continue
            lens = b["active"].map(len).to_numpy()
            x = np.zeros((len(b), size))
            x[np.repeat(np.arange(len(b)), lens), np.concatenate([np.asarray(a, int) for a in b["active"]])] = 1.0
            total += x.T @ (x * b["p"].to_numpy()[:, None])
            mass += b["p"].sum()
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": np.append(i, size), "j": np.append(j, size), "value": np.append(total[i, j], mass)})

    weighted = cache.select("active", F.exp(log_weight("active", lambdas) + F.ln("rows") - F.lit(z)).alias("p"))
    parts = weighted.mapInPandas(partial, "i long, j long, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def statistic_covariance(cache: DataFrame, lambdas: Sequence[float], size: int) -> DataFrame:
    """(i, j, cov) of the statistics, jitter on the diagonal; zero second moments included."""
    z = lambda0(cache, lambdas)
    second = _second_moments(cache, lambdas, z, size).persist()
    mean = second.filter("i = j").select("i", F.col("value").alias("m"))
    grid = cache.sparkSession.range(size * size).select(
        F.call_function("div", F.col("id"), F.lit(size)).alias("i"), (F.col("id") % size).alias("j"))
    out = grid.join(second, ["i", "j"], "left").join(F.broadcast(mean), "i", "left").join(
        F.broadcast(mean.select(F.col("i").alias("j"), F.col("m").alias("mj"))), "j", "left")
    cov = F.coalesce("value", F.lit(0.0)) - F.coalesce("m", F.lit(0.0)) * F.coalesce("mj", F.lit(0.0))
    return out.select("i", "j", (cov + F.when(F.col("i") == F.col("j"), JITTER).otherwise(0.0)).alias("cov"))


def moments_np(cache: DataFrame, lambdas: Sequence[float], size: int, shift: float | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Normaliser, mean and covariance; only d*d sums come to the driver.

    `shift` is a log normaliser known to be near; with it one job does the whole work.
    """
    z = lambda0(cache, lambdas) if shift is None else shift
    got = _second_moments(cache, lambdas, z, size).toArrow()
    i, j, value = (got.column(c).to_numpy() for c in ("i", "j", "value"))
    mass = value[i == size].sum()
    second = np.zeros((size, size))
    second[i[i < size], j[i < size]] = value[i < size] / mass
    mean = np.diag(second).copy()
    return z + float(np.log(mass)), mean, second - np.outer(mean, mean) + np.eye(size) * JITTER


def row_probabilities(spark: SparkSession, model: Model, lambdas: Sequence[float]) -> DataFrame:
    """Every possible row with its probability `p`."""
    rows = domain_rows(spark, model)
    z = lambda0(statistic_cache(rows), lambdas)
    return rows.withColumn("p", F.exp(log_weight("active", lambdas) - F.lit(z))).drop("active")


def query_means(probabilities: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model mean of every marginal query on some columns: (columns..., mean)."""
    return probabilities.groupBy(*columns).agg(F.sum("p").alias("mean"))


def conjugate_log_density(draws: DataFrame, chi: DataFrame, nu: float, cache: DataFrame, draws_at_once: int = 256,
                          vectors_at_once: int = 8192) -> DataFrame:
    """Unnormalised log density of the conjugate prior per draw: (draw_id, logp).

    `draws` has (draw_id, query_id, lam), `chi` (query_id, chi). The normaliser of a draw is a log-sum-exp over the cached
    statistic vectors. Draws are cut into blocks and vectors into chunks; a task takes one block and one chunk as
    matrices, and its log-sums, one per draw, are combined over the chunks. Neither draws nor vectors come to the driver.
    """
    dot = draws.join(chi, "query_id").groupBy("draw_id").agg(F.sum(F.col("chi") * F.col("lam")).alias("dot"))
    blocks = max(1, -(-draws.select("draw_id").distinct().count() // draws_at_once))
    chunks = max(1, -(-cache.count() // vectors_at_once))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = draws.select("draw_id", "query_id", "lam", F.pmod(F.xxhash64("draw_id"), F.lit(blocks)).cast("int").alias("__block"), to(chunks).alias("__chunk"))
    right = cache.select("active", "rows", F.pmod(F.xxhash64("active"), F.lit(chunks)).cast("int").alias("__chunk"), to(blocks).alias("__block"))

    def work(some: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names, place = np.unique(some["draw_id"].to_numpy(), return_inverse=True)
        if not len(names) or not len(vectors):
            return pd.DataFrame({"draw_id": names[:0], "logw": np.zeros(0)})
        size = 1 + max(int(some["query_id"].max()), max((max(a, default=0) for a in vectors["active"]), default=0))
        lam = np.full((len(names), size + 1), np.nan)
        lam[place, some["query_id"].to_numpy()] = some["lam"].to_numpy()
        lam[:, size] = 0.0  # stands in behind the end of short vectors
        width = int(vectors["active"].map(len).max())
        ids = np.full((len(vectors), width), size)
        for i, a in enumerate(vectors["active"]):
            ids[i, :len(a)] = a
        logw = np.broadcast_to(np.log(vectors["rows"].to_numpy(float)), (len(names), len(vectors))).copy()
        for j in range(width):
            logw += lam[:, ids[:, j]]
        logw[np.isnan(logw)] = -np.inf  # a vector whose parameter the draw does not have
        peak = logw.max(axis=1)
        known = np.isfinite(peak)
        sums = peak[known] + np.log(np.exp(logw[known] - peak[known, None]).sum(axis=1))
        return pd.DataFrame({"draw_id": names[known], "logw": sums})

    by, kind = ["__block", "__chunk"], draws.schema["draw_id"].dataType.simpleString()
    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(work, f"draw_id {kind}, logw double")
    z = log_sum_exp(sums, ["draw_id"], "logw", out="z")
    return dot.join(z, "draw_id").select("draw_id", (F.col("dot") - nu * F.col("z")).alias("logp"))


@dataclass
class Posterior:
    """Parameters given noisy counts: a normal approximation, and what the draws of weakly measured ones need."""

    mean: np.ndarray
    precision: np.ndarray
    iterations: int
    converged: bool
    shares: np.ndarray  # model means of the statistics at `mean`
    counts: np.ndarray  # the noisy counts
    rows: float
    sigma: float
    prior_sd: float

    def weak(self) -> np.ndarray:
        """Which parameters have an expected count within WEAK standard deviations of zero."""
        spread = np.sqrt(self.sigma ** 2 + self.rows * self.shares * (1 - self.shares))
        return self.rows * self.shares < WEAK * spread


Moments = Callable[[np.ndarray, float], "tuple[float, np.ndarray, Callable[[], np.ndarray]]"]


def cached_moments(cache: DataFrame, size: int) -> Moments:
    """Moments summed over the distinct statistic vectors of the whole domain, for models that have no clique tree."""
    rows = cut_lineage(cache)

    def moments(lam: np.ndarray, near: float | None):
        z, mean, cov = moments_np(rows, lam, size, near)
        return z, mean, lambda: cov

    return moments


def message_moments(spark: SparkSession, model: Model) -> Moments:
    """Moments by messages between the tables of a clique tree; the domain is never enumerated."""
    statistics = Statistics(CliqueTree.of(model.cliques, model.domain), model.cliques, model.ids)
    return lambda lam, near: statistics.moments(spark, lam)


def fit_noise_aware(source: DataFrame | Moments, noisy_counts: Sequence[float], n: float, sigma: float,
                    prior_sd: float = PRIOR_SD, max_iter: int = 150, strict: bool = True) -> Posterior:
    """Parameters with prior N(0, prior_sd^2) given counts ~ N(n mean, n cov + sigma^2 I).

    `source` gives the moments: a table of distinct statistic vectors, or a function such as `message_moments` makes.
    Fisher scoring: the driver solves one d*d system per step. The covariance is held
    during a step, so the step and its line search follow one objective. A full step is tried first; where it does not help,
    half the curvature of the means is added where it is positive, which keeps steps of nearly empty cells short. Without noise (sigma 0) the likelihood of the
    exponential family itself is maximised, which is concave. Steps end when one more would gain less than TOLERANCE in
    log density, a hundredth of a standard deviation. A fit that has not converged raises unless `strict`
    is off.
    """
    y = np.asarray(noisy_counts, float)
    d = len(y)
    lam, eye = np.zeros(d), np.eye(d)
    moments = cached_moments(source, d) if isinstance(source, DataFrame) else source
    z, mean, covariance = moments(lam, None)
    for step in range(1, max_iter + 1):
        cov = covariance()
        inner = np.linalg.inv(n * cov + (sigma ** 2 + 1e-9) * eye)
        gap = y - n * mean
        pull = inner @ gap
        precision = eye / prior_sd ** 2 + n * n * cov @ inner @ cov
        gradient = -lam / prior_sd ** 2 + n * cov @ pull
        bend = 0.5 * np.maximum(0.0, -pull * n * mean * (1 - mean) * (1 - 2 * mean)) * (sigma > 0)
        move = np.linalg.solve(precision + np.diag(bend), gradient)
        gain = gradient @ move
        if gain < TOLERANCE:
            break

        def loss(at: np.ndarray) -> float:
            left = y - n * mean
            return at @ at / prior_sd ** 2 + (left @ inner @ left if sigma > 0 else 2 * (n * z - y @ at))

        before = loss(lam)
        for direction, least in ((np.linalg.solve(precision, gradient), 0.2), (move, 1e-4)):
            direction, scale = np.clip(direction, -MAX_MOVE, MAX_MOVE), 1.0
            while True:
                trial = lam + scale * direction
                z, mean, covariance = moments(trial, z)
                if (better := loss(trial) <= before) or scale < least:
                    break
                scale /= 2
            if better:
                break
        lam = trial
    converged = bool(gain < CONVERGED)
    if strict and not converged:
        raise RuntimeError(f"the fit has not converged in {step} steps: a further step would gain {gain:.3g}")
    return Posterior(lam, precision, step, converged, mean, y, float(n), float(sigma), prior_sd)


def _weak_quantiles(p: Posterior, which: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Quantiles `u` (draws x parameters) of single parameters, all others held at the fit.

    The share of one statistic follows its own parameter exactly: its log odds move by as much as the parameter.
    """
    out = np.empty_like(u)
    for k, q in enumerate(which):
        grid, logf = _weak_density(p, q)
        cdf = np.cumsum(np.exp(logf - logf.max()))
        out[:, k] = np.interp(u[:, k] * cdf[-1], cdf, grid)
    return out


def _weak_density(p: Posterior, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and normalised log density of one parameter, all others held at the fit."""
    grid = np.linspace(-6.0, 6.0, GRID) * p.prior_sd
    share = np.clip(p.shares[q], 1e-300, 1 - 1e-12)
    odds = np.clip(np.log(share) - np.log1p(-share) + grid - p.mean[q], -700, 700)
    at = 1 / (1 + np.exp(-odds))
    var = p.sigma ** 2 + p.rows * at * (1 - at) + 1e-9
    logf = -(grid / p.prior_sd) ** 2 / 2 - (p.counts[q] - p.rows * at) ** 2 / (2 * var) - np.log(var) / 2
    top = logf.max()
    return grid, logf - top - np.log(np.exp(logf - top).sum() * (grid[1] - grid[0]))


def posterior_draws(spark: SparkSession, posterior: Posterior, draws: int, seed: int = 0) -> DataFrame:
    """(draw_id, query_id, lam); each draw is seeded by its own id.

    Well measured parameters are drawn from the normal approximation. The posterior of a weak one, such as that of an
    empty cell, is far from normal: flat below, a wall above. It is drawn from its own density, given the others.
    """
    mean, weak = posterior.mean, np.flatnonzero(posterior.weak())
    strong = np.setdiff1d(np.arange(len(mean)), weak)
    root = np.linalg.inv(np.linalg.cholesky(posterior.precision[np.ix_(strong, strong)])).T  # root @ root.T = precision^-1

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sources = [np.random.default_rng([seed, int(i)]) for i in b["id"]]
            lam = np.tile(mean, (len(b), 1))
            for row, source in zip(lam, sources):
                row[strong] += root @ source.standard_normal(len(strong))
            if len(weak) and len(b):
                lam[:, weak] = _weak_quantiles(posterior, weak, np.stack([source.random(len(weak)) for source in sources]))
            for i, row in zip(b["id"], lam):
                yield pd.DataFrame({"draw_id": np.full(len(mean), i), "query_id": np.arange(len(mean), dtype=np.int32), "lam": row})

    return spark.range(draws).mapInPandas(draw, "draw_id long, query_id int, lam double")


def log_posterior(posterior: Posterior, lam: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float:
    """Unnormalised noise-aware log density of parameters with the given moments."""
    spread = posterior.rows * cov + (posterior.sigma ** 2 + 1e-9) * np.eye(len(lam))
    left = posterior.counts - posterior.rows * mean
    return -lam @ lam / (2 * posterior.prior_sd ** 2) - (left @ np.linalg.solve(spread, left) + np.linalg.slogdet(spread)[1]) / 2


def draw_weights(posterior: Posterior, statistics: Statistics, lambdas: DataFrame) -> DataFrame:
    """(draw_id, logw): how much more likely each draw is than the approximation that it was drawn from says.

    Draws are spread over tasks; each costs the moments at its parameters.
    """
    weak = np.flatnonzero(posterior.weak())
    strong = np.setdiff1d(np.arange(len(posterior.mean)), weak)
    inside = posterior.precision[np.ix_(strong, strong)]
    densities = [_weak_density(posterior, q) for q in weak]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lam in b["lams"]:
                lam = np.asarray(lam, float)
                beliefs = marginals(statistics.tree, statistics.potentials(lam))[1]
                mean = statistics.read(beliefs)
                second = statistics.second_moments(beliefs, range(statistics.size))
                off = lam[strong] - posterior.mean[strong]
                drawn = -off @ inside @ off / 2 + sum(np.interp(lam[q], *d) for q, d in zip(weak, densities))
                out.append(log_posterior(posterior, lam, mean, (second + second.T) / 2 - np.outer(mean, mean)) - drawn)
            yield pd.DataFrame({"draw_id": b["draw_id"], "logw": out})

    vectors = lambdas.groupBy("draw_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "lam"))), lambda s: s["lam"]).alias("lams"))
    return vectors.mapInPandas(weigh, "draw_id long, logw double")


def effective_draws(weights: DataFrame) -> float:
    """How many equally weighted draws the weighted ones are worth."""
    w = F.exp(F.col("logw") - F.lit(weights.agg(F.max("logw")).first()[0]))
    a, b = weights.agg(F.sum(w), F.sum(w * w)).first()
    return float(a * a / b)


def resample_draws(lambdas: DataFrame, weights: DataFrame, draws: int, least: float = 10.0, seed: int = 0) -> DataFrame:
    """`draws` draws chosen by weight, evenly spaced over the running sum; raises where they are worth fewer than `least`."""
    rows = sorted(tuple(r) for r in weights.collect())  # one number for each draw
    w = np.exp(np.array([v for _, v in rows]) - max(v for _, v in rows))
    worth = float(w.sum() ** 2 / (w * w).sum())
    if worth < least:
        raise RuntimeError(f"{len(rows)} draws are worth {worth:.1f}: the approximation does not fit the posterior")
    at = (np.arange(draws) + np.random.default_rng(seed).random()) / draws * w.sum()
    taken = np.minimum(np.searchsorted(np.cumsum(w), at, side="right"), len(rows) - 1)
    chosen = lambdas.sparkSession.createDataFrame([(k, rows[i][0]) for k, i in enumerate(taken.tolist())], "draw_id long, __from long")
    return lambdas.withColumnRenamed("draw_id", "__from").join(F.broadcast(chosen), "__from").select("draw_id", "query_id", "lam")
