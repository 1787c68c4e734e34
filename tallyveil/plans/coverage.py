"""The interval-coverage experiment: generate, fit every table, combine, compare with the original fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.operators import regression as R
from tallyveil.operators import rubin as V
from tallyveil.operators.domain import Domain, encode
from tallyveil.plans.synthesiser import Fitted, Options, generate, generate_counts, release_repeats
from tallyveil.session import cut_lineage

# The levels of the experiment.
LEVELS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def true_values(original_coded: DataFrame, features: Sequence[str], target: str, add_constant: bool = False, rows: str | float = 1.0) -> DataFrame:
    """Estimates on the original table: (param_index, param, true_value)."""
    fit = R.fit_many(original_coded, [], features, target, rows, add_constant)
    return fit.select("param_index", "param", F.col("q").alias("true_value"))


def coverage_records(original: DataFrame, fitted: Fitted, target: str, repeats: int, tables: int, n: int | None = None,
                     levels: Sequence[float] = LEVELS, add_constant: bool = False, salt: str = "coverage", rows: str | float = 1.0) -> DataFrame:
    """One record per repeat, level and parameter.

    All repeats * tables data sets are generated and fitted in one go; the levels are spread at the end,
    on one row per repeat and parameter. `rows` names the row numbers of an original counted before.
    """
    synthetic = generate(original.sparkSession, fitted, repeats * tables, n, salt=salt, labels=False)
    return _records(original, fitted, synthetic, 1.0, target, repeats, tables, n, levels, add_constant, rows)


def repeated_records(original: DataFrame, domain: Domain, options: Options, target: str, repeats: int, tables: int, rows: str,
                     n: int | None = None, levels: Sequence[float] = LEVELS, add_constant: bool = False) -> DataFrame:
    """The whole experiment: every repeat has a release of its own, every table a draw of its own.

    Tables of n rows (default: as many as the original) are drawn as counts of distinct rows, which is all the fits need.
    """
    fitted = release_repeats(original, domain, options, repeats, tables, rows)
    synthetic = cut_lineage(generate_counts(fitted, n, options.seed))
    return _records(original, fitted, synthetic, "rows", target, repeats, tables, n, levels, add_constant, rows)


def _records(original, fitted, synthetic, number, target, repeats, tables, n, levels, add_constant, rows) -> DataFrame:
    domain = fitted.domain
    features = [c for c in domain.columns if c != target]
    truth = true_values(encode(original, domain), features, target, add_constant, rows)
    n_orig = int(fitted.meta["rows"])
    fits = R.fit_many(synthetic, ["dataset_id"], features, target, number, add_constant)
    per_repeat = fits.withColumn("repeat", F.call_function("div", F.col("dataset_id").cast("long"), F.lit(tables)).cast("int"))
    grid = truth.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    totals = V.total_variance(V.combined(per_repeat, ["repeat", "param_index"], grid), float(n or n_orig), float(n_orig))
    return V.against_truth(V.intervals(totals, levels)).select(
        "repeat", "param_index", "param", "level", "true_value", "m", "low", "high", "width", "contains", "nn_low", "nn_high", "nn_width", "nn_contains")
