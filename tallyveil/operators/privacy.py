"""Differentially private release of counts and selection of column pairs.

Two noise sources: `salt=...` computes noise from a key (repeatable, for checks, protects nothing);
`salt=None` takes operating-system entropy. The latter gives new noise each time a plan runs, so such
tables are only handed out after they were written once (`release`).
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions.keyed import md5_gumbel, md5_normal, md5_uniform, py_gumbel
from tallyveil.functions.special import gaussian_sigma_np
from tallyveil.functions.sqltext import array as literals
from tallyveil.functions.sqltext import literal
from tallyveil.operators.domain import Domain
from tallyveil.operators.marginals import (Clique, all_pairs, canonical, cell_grid, clique_table, count_all_cells,
                                           count_cells, count_once, pair_sides, query_ids)
from tallyveil.session import scratch_path

SUPPORT_SIGMAS = 3.0  # a cell is supported when its noisy count reaches this many sigmas

# One neighbour relation throughout: tables of equal size that differ in one row. A replaced row moves one count down and one
# up, so the counts of a column change by sqrt(2) in all, and an L1 pair score by 2.
COUNT_SENSITIVITY = math.sqrt(2.0)
SCORE_SENSITIVITY = 2.0


# ---------------------------------------------------------------- budgets


def rho_of(eps: Column, delta: Column) -> Column:
    """zCDP budget of an (eps, delta) budget, per row of a grid."""
    beta2 = -F.ln(delta)
    return F.pow(F.sqrt(beta2 + eps) - F.sqrt(beta2), 2)


def rho_number(eps: float, delta: float) -> float:
    beta2 = -math.log(delta)
    return (math.sqrt(beta2 + eps) - math.sqrt(beta2)) ** 2


def zcdp_sigma(rho: Column, sensitivity: Column) -> Column:
    """Noise of one Gaussian mechanism under rho-zCDP."""
    return sensitivity / F.sqrt(2 * rho)


def composed_sigma(sensitivities: DataFrame, budget_keys: Sequence[str]) -> DataFrame:
    """One sigma for several mechanisms per budget: rows (keys, rho, sensitivity, times) -> (keys, sigma)."""
    total = F.sum(F.col("times") * F.col("sensitivity") * F.col("sensitivity"))
    return sensitivities.groupBy(*budget_keys).agg(F.sqrt(total / (2 * F.first("rho"))).alias("sigma"))


class Ledger:
    """What has been spent of one zCDP budget; refuses to go beyond it."""

    def __init__(self, eps: float, delta: float):
        self.eps, self.delta, self.rho = eps, delta, rho_number(eps, delta)
        self.entries: list[tuple[str, float]] = []

    def spend(self, what: str, rho: float) -> float:
        if sum(r for _, r in self.entries) + rho > self.rho * (1 + 1e-9):
            raise ValueError(f"{what} needs rho {rho}, more than is left")
        self.entries.append((what, rho))
        return rho

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, "mechanism string, rho double")


# ---------------------------------------------------------------- Gaussian noise


def noisy(df: DataFrame, value: str, sigma: Column | float, key: Sequence[str], out: str, salt: str | None) -> DataFrame:
    """value + N(0, sigma^2) as column `out`."""
    scale = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    if salt is not None:
        return df.withColumn(out, F.col(value) + scale * md5_normal(salt, *key))
    scaled = df.withColumn(out, scale)
    schema = T.StructType(scaled.schema.fields)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.Generator(np.random.PCG64(secrets.randbits(256)))
        for b in batches:
            yield b.assign(**{out: b[value].to_numpy(float) + b[out].to_numpy(float) * rng.standard_normal(len(b))})

    return scaled.mapInPandas(draw, schema)


def release(df: DataFrame, drop: Sequence[str], path: str | None = None) -> DataFrame:
    """Write a noisy table once, without its exact columns, and hand out only what was written."""
    target = path or scratch_path(df.sparkSession, "release")
    df.drop(*drop).write.mode("error").parquet(target)
    return df.sparkSession.read.parquet(target)


def release_gaussian(df: DataFrame, value: str, sigma: Column | float, key: Sequence[str], path: str | None = None) -> DataFrame:
    """The private Gaussian mechanism on a count table: entropy noise, written once."""
    return release(noisy(df, value, sigma, key, f"{value}_noisy", None), [value], path)


# ---------------------------------------------------------------- measuring columns, shrinking domains


def measure(coded: DataFrame, cliques: Sequence[Clique], domain: Domain, sigma: float,
            weights: Sequence[float] | None = None, salt: str | None = None, rows: str | None = None) -> DataFrame:
    """Noisy counts of all cells: (clique_id, cell, y, sigma). Weights share the noise among cliques.

    `rows` names the column of row numbers when the table was counted before.
    """
    w = np.ones(len(cliques)) if weights is None else np.asarray(weights, float)
    scales = [float(s) for s in sigma / (w / np.linalg.norm(w))]
    counts = count_all_cells(coded, cliques, domain, rows)
    scale = F.element_at(F.lit(scales), F.col("clique_id") + 1)
    out = noisy(counts.withColumn("sigma", scale), "n", F.col("sigma"), ["clique_id", "cell"], "y", salt)
    return out.drop("n") if salt is not None else release(out, ["n"])


def compress(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge unsupported values of each column.

    Returns supports (clique_id, cell, code, merged) and the new measurements
    (clique_id, code, y, sigma, members); a merged row's y is divided by the root of its members.
    """
    marked = measured.withColumn("merged", F.col("y") < SUPPORT_SIGMAS * F.col("sigma"))
    by = W.partitionBy("clique_id")
    place = F.sum((~F.col("merged")).cast("int")).over(by.orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    size = F.sum((~F.col("merged")).cast("int")).over(by)
    placed = marked.withColumn("code", F.when(F.col("merged"), size).otherwise(place).cast("int"))
    supports = placed.select("clique_id", "cell", "code", "merged")
    grouped = placed.groupBy("clique_id", "code").agg(
        F.sum("y").alias("total"), F.first("sigma").alias("sigma"), F.count("*").alias("members"))
    return supports, grouped.select("clique_id", "code", (F.col("total") / F.sqrt("members")).alias("y"), "sigma", "members")


def support_lists(supports: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[int, bool]]]:
    """(new code, merged) per old code of each column; as long as the domain, which is bounded."""
    rows = supports.orderBy("clique_id", "cell").collect()
    out: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        out[columns[r["clique_id"]]].append((r["code"], r["merged"]))
    return out


def remap(coded: DataFrame, lists: dict[str, list[tuple[int, bool]]]) -> DataFrame:
    """Codes -> codes of the compressed domain."""
    return coded.select([F.get(F.lit([p[0] for p in lists[c]]), F.col(c)).alias(c) if c in lists else F.col(c)
                         for c in coded.columns])


def compressed_domain(lists: dict[str, list[tuple[int, bool]]]) -> Domain:
    return Domain({c: tuple(str(i) for i in range(max(p[0] for p in ps) + 1)) for c, ps in lists.items()})


def unmap(coded: DataFrame, lists: dict[str, list[tuple[int, bool]]], key: str, salt: str = "unmap") -> DataFrame:
    """Undo `remap`; a merged code becomes a random member of what was merged."""
    def back(c: str) -> Column:
        kept = [i for i, p in enumerate(lists[c]) if not p[1]]
        merged = [i for i, p in enumerate(lists[c]) if p[1]]
        own = F.get(F.lit(kept), F.col(c)) if kept else F.lit(None).cast("int")
        if not merged:
            return own.alias(c)
        pick = F.get(F.lit(merged), F.floor(md5_uniform(f"{salt}/{c}", key) * len(merged)).cast("int"))
        return F.when(F.col(c) == len(kept), pick).otherwise(own).alias(c)

    return coded.select([back(c) if c in lists else F.col(c) for c in coded.columns])


# ---------------------------------------------------------------- choosing pairs


def column_shares(ones: Sequence, columns: Sequence[str]) -> tuple[float, list[list[float]]]:
    """Estimated number of rows, and per column the share of each code, from noisy one-way counts.

    `ones` are the collected measurements (clique_id, code, y, members); there is one per domain value.
    """
    x: list[dict[int, float]] = [{} for _ in columns]
    for r in ones:
        x[r["clique_id"]][r["code"]] = r["y"] * math.sqrt(r["members"])
    totals = [math.fsum(c.values()) for c in x]
    shares = []
    for c in x:
        mass = math.fsum(max(v, 0.0) for v in c.values())
        shares.append([max(c[i], 0.0) / mass if mass > 0 else 1.0 / len(c) for i in range(len(c))])
    return sum(totals) / len(totals), shares


def pair_scores(coded: DataFrame, columns: Sequence[str], domain: Domain, ones: Sequence, rows: str | None = None) -> DataFrame:
    """L1 distance of each pair's true counts from independence under noisy one-way counts.

    Cells nobody is in contribute their expected count, and expected counts add up to the estimated number
    of rows; so the seen cells are enough and no grid of all cells is built. Exact scores are an intermediate and must
    not be handed out in a private run.
    """
    pairs = all_pairs(columns)
    n_hat, shares = column_shares(ones, columns)
    place = {c: i for i, c in enumerate(columns)}
    side = pair_sides(pairs, domain)
    table = "array(" + ", ".join(literals(s) for s in shares) + ")"
    share = lambda i, code: f"get(get({table}, get({literals([place[p[i]] for p in pairs])}, clique_id)), {code})"
    expected = F.expr(f"{literal(n_hat)} * {share(0, side['left_code'])} * {share(1, side['right_code'])}")
    gaps = count_cells(coded, pairs, domain, rows).withColumn("__e", expected).groupBy("clique_id").agg(
        F.sum(F.abs(F.col("n") - F.col("__e")) - F.col("__e")).alias("__s"))
    return gaps.select("clique_id", F.expr(side["left_col"]).alias("left_col"), F.expr(side["right_col"]).alias("right_col"),
                       (F.col("__s") + F.lit(n_hat)).alias("score"))


def exponential_choice(candidates: DataFrame, group: Sequence[str], item: str, score: str, eps: Column | float,
                       sensitivity: float = 1.0, monotonic: bool = False, salt: str = "exp") -> DataFrame:
    """Exponential mechanism per group by the Gumbel-max rule: (group..., chosen)."""
    factor = (1.0 if monotonic else 0.5) / sensitivity
    scale = eps if isinstance(eps, Column) else F.lit(float(eps))
    noisy_score = F.lit(factor) * scale * F.col(score) + md5_gumbel(salt, *group, item)
    return candidates.groupBy(*group).agg(F.max_by(item, noisy_score).alias("chosen"))


def noisy_max(candidates: DataFrame, group: Sequence[str], item: str, value: str, rho: float, sensitivity: float,
              salt: str = "max") -> DataFrame:
    """Report-noisy-max per group with Gumbel noise: (group..., chosen)."""
    noise = F.lit(sensitivity / math.sqrt(2 * rho)) * md5_gumbel(salt, *group, item)
    return candidates.groupBy(*group).agg(F.max_by(item, F.col(value) + noise).alias("chosen"))


def spanning_pairs(scores: dict[Clique, float], columns: Sequence[str], rho: float | None,
                   required: Sequence[Clique] = (), salt: str | None = None) -> list[Clique]:
    """Join all columns by pairs, each chosen by the exponential mechanism among those that connect two parts.

    Runs on the driver over one score per column pair. `rho=None` takes the best pair without noise.
    """
    part = {c: c for c in columns}

    def root(c):
        while part[c] != c:
            c = part[c]
        return c

    chosen: list[Clique] = []
    for a, b in required:
        if a not in part or b not in part:
            raise ValueError(f"unknown columns in {(a, b)}")
        if (a, b) not in chosen and (b, a) not in chosen:
            chosen.append((a, b))
        part[root(a)] = root(b)
    rounds = len({root(c) for c in columns}) - 1
    if rounds < 1:  # the required pairs already connect everything
        return chosen
    eps = math.sqrt(8 * rho / rounds) if rho is not None else None
    rng = np.random.Generator(np.random.PCG64(secrets.randbits(256)))
    for i in range(rounds):
        open_pairs = [p for p in scores if root(p[0]) != root(p[1])]
        if eps is None:
            best = max(open_pairs, key=lambda p: (scores[p], p))
        else:
            noise = {p: py_gumbel(salt, i, *p) if salt is not None else float(rng.gumbel()) for p in open_pairs}
            best = max(open_pairs, key=lambda p: 0.5 * eps * scores[p] / SCORE_SENSITIVITY + noise[p])
        chosen.append(best)
        part[root(best[0])] = root(best[1])
    return chosen


def score_dict(scores: DataFrame) -> dict[Clique, float]:
    """One number per column pair on the driver."""
    return {(r["left_col"], r["right_col"]): r["score"] for r in scores.collect()}


def select_pairs(coded: DataFrame, domain: Domain, rho_measure: float | None, rho_select: float | None,
                 required: Sequence[Clique] = (), salt: str | None = None,
                 return_scores: bool = False, rows: str | None = None) -> tuple[list[Clique], DataFrame | None]:
    """Measure columns, shrink the domain, score pairs, pick a spanning set.

    `rho_*=None` means no privacy: exact counts and exact choice, and only then may scores be returned.
    """
    if return_scores and rho_select is not None:
        raise ValueError("exact scores leak; they are only returned without privacy")
    if rows is None:
        coded, rows = count_once(coded, domain)
    columns = domain.columns
    singles = [(c,) for c in columns]
    if rho_measure is None:
        measured = count_all_cells(coded, singles, domain, rows).select("clique_id", "cell", F.col("n").cast("double").alias("y"), F.lit(0.0).alias("sigma"))
    else:
        measured = measure(coded, singles, domain, COUNT_SENSITIVITY / math.sqrt(2 * rho_measure), salt=salt, rows=rows)
    supports, ones = compress(measured)
    lists = support_lists(supports, columns)
    small = remap(coded, lists)
    scores = pair_scores(small, columns, compressed_domain(lists), ones.collect(), rows)
    chosen = spanning_pairs(score_dict(scores), columns, rho_select, required, None if salt is None else f"{salt}/select")
    return chosen, scores if return_scores else None


# ---------------------------------------------------------------- the released statistic


def statistic_cells(coded: DataFrame, cliques: Sequence[Clique], domain: Domain, rows: str | None = None) -> DataFrame:
    """Exact counts of the canonical cells: (clique_id, cell, query_id, n)."""
    spark = coded.sparkSession
    queries = query_ids(canonical(cell_grid(spark, cliques, domain), clique_table(spark, cliques, domain)))
    seen = count_cells(coded, cliques, domain, rows)
    return queries.join(seen, ["clique_id", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def statistic_sigma(n_sets: int, eps: float, delta: float) -> float:
    """Noise for all sets at once under replace-one neighbours."""
    return float(gaussian_sigma_np(eps, delta, math.sqrt(2.0 * n_sets)))


def release_statistic(coded: DataFrame, cliques: Sequence[Clique], domain: Domain, sigma: float,
                      salt: str | None = None, path: str | None = None, rows: str | None = None) -> DataFrame:
    """Noisy canonical counts (clique_id, cell, query_id, y); sigma 0 releases them exactly."""
    cells = statistic_cells(coded, cliques, domain, rows)
    if sigma == 0:
        return cells.select("clique_id", "cell", "query_id", F.col("n").cast("double").alias("y"))
    out = noisy(cells, "n", sigma, ["clique_id", "cell"], "y", salt)
    return out.drop("n") if salt is not None else release(out, ["n"], path)
