"""Fit a private model of a table and generate synthetic tables from it."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.operators import maxent as X
from tallyveil.operators import privacy as D
from tallyveil.operators import treemodel as TM
from tallyveil.operators.cliquetree import CliqueTree, Statistics, step_conditionals
from tallyveil.operators.domain import Domain, decode, encode
from tallyveil.operators.factors import elimination_order, log_sum_exp
from tallyveil.operators.marginals import Clique, canonical_count, check_cliques, count_all_cells, encode_counted
from tallyveil.operators.sampling import sample_counts, sample_tree
from tallyveil.session import broadcast_checked, cut_lineage
from tallyveil.sources.store import load_model, store_model

METHODS = ("tree", "explicit")


@dataclass(frozen=True)
class Options:
    """How to fit. `pairs` given: no selection. `budget="split"` shares one budget over all steps,
    `"twice"` spends it in the selection and again in the release. `salt` computes noise from keys."""

    epsilon: float = 1.0
    delta: float = 1e-6
    pairs: Sequence[Clique] | None = None
    required: Sequence[Clique] = ()
    method: str = "tree"
    budget: str = "split"
    no_privacy: bool = False
    draws: int = 20
    salt: str | None = None
    seed: int = 0


@dataclass
class Plan:
    """What a fit would measure, before any of it is released."""

    pairs: list[Clique]
    sigma: float
    canonical_cells: int
    width: int
    scores: DataFrame | None = None
    spent: list[tuple[str, float]] = field(default_factory=list)


@dataclass
class Fitted:
    """A fitted model: conditional tables per posterior draw, the order in which columns are drawn, and what decodes them."""

    cpts: DataFrame
    tree: TM.Tree | CliqueTree
    lambdas: DataFrame | None
    domain: Domain
    pairs: list[Clique]
    meta: dict


def model_width(pairs: Sequence[Clique], columns: Sequence[str]) -> int:
    """Columns that meet in the largest table when columns are summed out one by one."""
    scopes = [set(p) for p in pairs] + [{c} for c in columns]
    widest = 1
    for c in elimination_order([sorted(s) for s in scopes]):
        union = set().union(*[s for s in scopes if c in s])
        widest = max(widest, len(union))
        scopes = [s for s in scopes if c not in s] + ([union - {c}] if union - {c} else [])
    return widest


def generate_counts(fitted: Fitted, n: int | None = None, seed: int = 0) -> DataFrame:
    """One synthetic table of n rows from every draw, as distinct coded rows with their number: (dataset_id, columns..., rows)."""
    return sample_counts(fitted.cpts, fitted.tree, fitted.domain, n or int(fitted.meta["rows"]), seed)


def check_shape(o: Options, domain: Domain, whole: bool = False) -> None:
    """Refuse pairs that the method cannot use before anything is measured or selected; `whole`: all pairs are there.

    What spends budget also needs a declared domain: a release, or a choice of pairs.
    """
    if not o.no_privacy and (whole or o.pairs is None):
        domain.require_declared()
    fixed = [tuple(p) for p in (o.required if o.pairs is None else o.pairs)]
    if o.method == "tree":
        TM.Tree.of(fixed, domain.columns, partly=o.pairs is None or not whole)
    else:
        CliqueTree.of(fixed, domain)


def plan_fit(coded: DataFrame, domain: Domain, o: Options, return_scores: bool = False, rows: str | None = None) -> Plan:
    """Choose pairs and noise; releases nothing but the choice of pairs. Given pairs may have any shape, as nothing is spent."""
    if o.method not in METHODS:
        raise ValueError(f"unknown method {o.method!r}, expected one of {METHODS}")
    if o.budget not in ("split", "twice"):
        raise ValueError(f"unknown budget {o.budget!r}")
    check_cliques([*(o.pairs or []), *o.required], domain)
    if o.pairs is None:
        check_shape(o, domain)
    ledger = D.Ledger(o.epsilon, o.delta)
    scores = None
    if o.pairs is not None:
        pairs = [tuple(p) for p in o.pairs]
    elif o.no_privacy:
        pairs, scores = D.select_pairs(coded, domain, None, None, o.required, return_scores=return_scores, rows=rows)
    else:
        part = ledger.rho / 3
        pairs, scores = D.select_pairs(coded, domain, ledger.spend("measure columns", part), ledger.spend("select pairs", part),
                                       o.required, o.salt, return_scores, rows)
    if o.no_privacy:
        sigma = 0.0
    elif o.budget == "twice" or o.pairs is not None:
        sigma = D.statistic_sigma(len(pairs), o.epsilon, o.delta)
        if o.pairs is not None:
            ledger.spend("release", ledger.rho)
    else:
        sigma = math.sqrt(2.0 * len(pairs)) / math.sqrt(2 * ledger.spend("release", ledger.rho / 3))
    return Plan(pairs, sigma, canonical_count(pairs, domain), model_width(pairs, domain.columns), scores, ledger.entries)


def fit(df: DataFrame, domain: Domain, o: Options = Options(), rows: str | None = None) -> Fitted:
    """Fit a model to a label table over a declared domain.

    The table is read once, to count its distinct rows; `rows` names their number when that was done before.
    """
    check_cliques([*(o.pairs or []), *o.required], domain)
    check_shape(o, domain, whole=True)
    coded, rows = (encode(df, domain), rows) if rows else encode_counted(df, domain)
    plan = plan_fit(coded, domain, o, rows=rows)
    n = coded.agg(F.sum(rows)).first()[0] if rows else coded.count()
    meta = {"rows": n, "epsilon": o.epsilon, "delta": o.delta, "sigma": plan.sigma, "method": o.method, "draws": o.draws,
            "canonical_cells": plan.canonical_cells, "width": plan.width, "no_privacy": o.no_privacy}
    if o.method == "explicit":
        return _fit_explicit(coded, domain, o, plan, n, meta, rows)
    tree = TM.Tree.of(plan.pairs, domain.columns)
    counts = count_all_cells(coded, plan.pairs, domain, rows)
    if plan.sigma == 0:
        released = counts.withColumn("y", F.col("n").cast("double")).drop("n")
    else:
        noisy = D.noisy(counts, "n", plan.sigma, ["clique_id", "cell"], "y", o.salt)
        released = noisy.drop("n") if o.salt is not None else D.release(noisy, ["n"])
    per_draw = TM.consistent_draws(released, plan.pairs, domain, n, o.draws, plan.sigma, f"{o.salt or o.seed}/draws")
    cpts = TM.conditionals(per_draw, plan.pairs, domain, tree, by=["draw_id"])
    return Fitted(cpts, tree, None, domain, plan.pairs, meta)


def _fit_explicit(coded: DataFrame, domain: Domain, o: Options, plan: Plan, n: int, meta: dict, rows: str | None) -> Fitted:
    spark = coded.sparkSession
    released = D.release_statistic(coded, plan.pairs, domain, plan.sigma, o.salt, rows=rows).persist()
    model = X.Model.of(domain, plan.pairs, released)
    y = [r["y"] for r in released.orderBy("query_id").select("y").collect()]
    tree = CliqueTree.of(plan.pairs, domain)
    statistics = Statistics(tree, plan.pairs, model.ids)
    posterior = X.fit_noise_aware(lambda lam, near: statistics.moments(spark, lam), y, n, plan.sigma)
    lambdas = cut_lineage(X.posterior_draws(spark, posterior, o.draws, o.seed))
    cpts = cut_lineage(step_conditionals(statistics, lambdas))
    meta = {**meta, "converged": posterior.converged, "iterations": posterior.iterations}
    return Fitted(cpts, tree, lambdas, domain, plan.pairs, meta)


def chain_conditionals(spark: SparkSession, model: X.Model, lambdas: DataFrame, draws: int) -> DataFrame:
    """Cell probabilities per draw over the whole domain: (draw_id, cell_id, p).

    Draws are spread from the domain rows, so both scale out; the parameters of a draw are one small row.
    """
    vectors = lambdas.groupBy("draw_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "lam"))), lambda s: s["lam"]).alias("lams"))
    rows = X.domain_rows(spark, model).select("cell_id", "active").withColumn("draw_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    weight = F.aggregate("active", F.lit(0.0), lambda acc, q: acc + F.get("lams", q))
    weighted = rows.join(broadcast_checked(vectors, draws, 8 * model.size), "draw_id").select("draw_id", "cell_id", weight.alias("logw"))
    z = log_sum_exp(weighted, ["draw_id"], out="z")
    return weighted.join(F.broadcast(z), "draw_id").select("draw_id", "cell_id", F.exp(F.col("logw") - F.col("z")).alias("p"))


def generate(spark: SparkSession, fitted: Fitted, m: int, n: int | None = None, salt: str = "sample", labels: bool = True, **kw) -> DataFrame:
    """m synthetic tables of n rows in one DataFrame with `dataset_id`, each from one posterior draw."""
    n = n or int(fitted.meta["rows"])
    draws = int(fitted.meta["draws"])
    out = sample_tree(spark, fitted.cpts, fitted.tree, fitted.domain, n, m, draws, salt=salt, **kw)
    return decode(out, fitted.domain) if labels else out


def release_repeats(df: DataFrame, domain: Domain, o: Options, repeats: int, tables: int, rows: str) -> Fitted:
    """As many releases of the same counts as `repeats`, each with draws for its own tables, in one plan.

    Table d belongs to release d / tables and has a posterior draw of its own. A release spends the budget of the options,
    so this is for experiments on how intervals behave.
    """
    if o.pairs is None or o.method != "tree":
        raise ValueError("repeated releases take given pairs and the tree model")
    check_cliques(o.pairs, domain)
    check_shape(o, domain, whole=True)
    coded = encode(df, domain)
    plan = plan_fit(coded, domain, o, rows=rows)
    n = coded.agg(F.sum(rows)).first()[0]
    tree = TM.Tree.of(plan.pairs, domain.columns)
    counts = count_all_cells(coded, plan.pairs, domain, rows).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    if plan.sigma == 0:
        released = counts.withColumn("y", F.col("n").cast("double")).drop("n")
    else:
        noisy = D.noisy(counts, "n", plan.sigma, ["repeat", "clique_id", "cell"], "y", o.salt)
        released = noisy.drop("n") if o.salt is not None else D.release(noisy, ["n"])
    per_draw = TM.consistent_draws(released, plan.pairs, domain, n, tables, plan.sigma, f"{o.salt or o.seed}/draws", by=["repeat"])
    per_draw = per_draw.withColumn("draw_id", F.col("repeat") * tables + F.col("draw_id")).drop("repeat")
    meta = {"rows": n, "epsilon": o.epsilon, "delta": o.delta, "sigma": plan.sigma, "method": o.method, "draws": repeats * tables}
    return Fitted(TM.conditionals(per_draw, plan.pairs, domain, tree, by=["draw_id"]), tree, None, domain, plan.pairs, meta)


def count_sigma(rho: float) -> float:
    """Noise that spends rho on a table of counts under one replaced row."""
    return D.COUNT_SENSITIVITY / math.sqrt(2 * rho)


def select_measure_generate(df: DataFrame, domain: Domain, epsilon: float, delta: float, salt: str | None = None) -> DataFrame:
    """Shrink the domain, choose pairs, measure them, generate one table of the same size, undo the shrinking."""
    domain.require_declared()
    spark, columns = df.sparkSession, domain.columns
    ledger = D.Ledger(epsilon, delta)
    coded, counted = encode_counted(df, domain)
    measured = D.measure(coded, [(c,) for c in columns], domain, count_sigma(ledger.spend("measure columns", ledger.rho / 3)), salt=salt, rows=counted)
    supports, ones = D.compress(measured)
    lists = D.support_lists(supports, columns)
    small, small_domain = D.remap(coded, lists), D.compressed_domain(lists)
    scores = D.score_dict(D.pair_scores(small, columns, small_domain, ones.collect(), counted))
    pairs = D.spanning_pairs(scores, columns, ledger.spend("select pairs", ledger.rho / 3), salt=None if salt is None else f"{salt}/select")
    cells = D.measure(small, pairs, small_domain, count_sigma(ledger.spend("measure pairs", ledger.rho / 3)), salt=None if salt is None else f"{salt}/pairs", rows=counted)
    n = max(1, round(ones.select((F.col("y") * F.sqrt("members")).alias("x"), "clique_id").groupBy("clique_id").agg(F.sum("x").alias("s")).agg(F.avg("s")).first()[0]))
    tree = TM.Tree.of(pairs, columns)
    agreed = TM.consistent_draws(cells, pairs, small_domain, n, 1, 0.0, "", spread=False)
    cpts = TM.conditionals(agreed, pairs, small_domain, tree)
    rows = sample_tree(spark, cpts, tree, small_domain, n, 1)
    return decode(D.unmap(rows, lists, "row_id"), domain).select("row_id", *columns)


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Store a fitted model as tables."""
    meta = {**fitted.meta, "pairs": json.dumps(fitted.pairs), "labels": json.dumps({c: list(v) for c, v in fitted.domain.labels.items()})}
    tables = {"cpts": fitted.cpts}
    if fitted.lambdas is not None:
        tables["lambdas"] = fitted.lambdas
    store_model(spark, path, tables, meta)


def load(spark: SparkSession, path: str) -> Fitted:
    tables, meta = load_model(spark, path)
    domain = Domain.declare(json.loads(meta["labels"]))
    pairs = [tuple(p) for p in json.loads(meta["pairs"])]
    tree = TM.Tree.of(pairs, domain.columns) if meta["method"] == "tree" else CliqueTree.of(pairs, domain)
    return Fitted(tables["cpts"], tree, tables.get("lambdas"), domain, pairs, {**meta, "rows": int(meta["rows"]), "draws": int(meta["draws"])})
