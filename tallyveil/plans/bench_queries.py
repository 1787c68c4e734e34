"""The headline work of the benchmark; each entry runs to the end and discards its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.operators import marginals as A
from tallyveil.operators import privacy as D
from tallyveil.operators import quality as Q
from tallyveil.operators import regression as R
from tallyveil.operators.binning import bin_code, fit_edges
from tallyveil.operators.domain import Domain, encode
from tallyveil.plans.analysis import coverage_run
from tallyveil.plans.base import COLUMNS, PAIRS, binned, declared, items
from tallyveil.plans.synthesiser import Options, fit, generate

ITEM_COLUMNS = ["flag", "line", "discount", "tax", "quantity", "price"]


def _drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _items(spark, sf) -> tuple[DataFrame, Domain]:
    """600k sold items (sf0.1) as six label columns, two of them binned, counted in one pass."""
    raw = items(spark, sf)
    edges = fit_edges(raw, ["quantity", "price"], 5)
    labels = raw.select("flag", "line", "discount", "tax", *[bin_code(c, edges[c]).cast("string").alias(c) for c in ("quantity", "price")])
    rows = A.count_rows(labels, ITEM_COLUMNS)
    domain = Domain.infer(rows, ITEM_COLUMNS)
    return encode(rows, domain), domain


def _orders(spark, sf, names=COLUMNS) -> tuple[DataFrame, Domain]:
    """Orders with a two-valued status, counted in one pass."""
    two = F.when(F.col("status") == "F", "F").otherwise("O")
    rows = A.count_rows(binned(spark, sf).withColumn("status", two), names)
    return rows, declared(names, status=["F", "O"])


def all_pair_marginals(spark, sf):
    """Every two-way marginal of six columns over all items, zero cells included."""
    df, domain = _items(spark, sf)
    _drain(A.count_all_cells(df, A.all_pairs(ITEM_COLUMNS), domain, "rows"))


def chi_square_ranking(spark, sf):
    df, domain = _items(spark, sf)
    _drain(Q.rank_pairs(Q.pair_chi_square(df, domain, rows="rows"), "statistic"))


def private_pair_selection(spark, sf):
    df, domain = _items(spark, sf)
    D.select_pairs(df, domain, 0.01, 0.01, rows="rows")


def fit_and_five_tables(spark, sf):
    """Fit over all orders and generate 5 tables of 2000 rows."""
    labels, domain = _orders(spark, sf)
    _drain(generate(spark, fit(labels, domain, Options(epsilon=1.0, draws=5), "rows"), 5, 2000))


def explicit_fit_and_five_tables(spark, sf):
    """The same with the noise-aware maximum-entropy fit on three columns and all their pairs."""
    names = COLUMNS[:3]
    labels, domain = _orders(spark, sf, names)
    options = Options(epsilon=1.0, draws=5, method="explicit", pairs=A.all_pairs(names))
    _drain(generate(spark, fit(labels, domain, options, "rows"), 5, 2000))


def hundred_tables(spark, sf):
    """100 tables of 30 000 rows from 20 posterior draws."""
    labels, domain = _orders(spark, sf)
    _drain(generate(spark, fit(labels, domain, Options(epsilon=1.0, pairs=PAIRS), "rows"), 100, 30_000))


def hundred_regressions(spark, sf):
    """Logistic regressions of 100 generated tables of 30 000 rows."""
    labels, domain = _orders(spark, sf)
    rows = generate(spark, fit(labels, domain, Options(epsilon=1.0, pairs=PAIRS), "rows"), 100, 30_000, labels=False)
    _drain(R.fit_many(rows, ["dataset_id"], COLUMNS[1:], "status"))


def coverage_experiment(spark, sf):
    """50 repeats with a release each x 19 levels x 100 tables as large as the original."""
    _drain(coverage_run(spark, sf))


QUERIES = {f.__name__: f for f in (
    all_pair_marginals, chi_square_ranking, private_pair_selection, fit_and_five_tables, explicit_fit_and_five_tables,
    hundred_tables, hundred_regressions, coverage_experiment)}
