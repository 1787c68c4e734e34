"""Combining estimates from synthetic tables, and coverage of the intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.special import t_halfwidth

HUGE_VARIANCE = 1000.0  # estimates at or above this variance are left out


def aggregates(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., m, q_m, b_m, u_m): count, mean and sample variance of q, mean of u."""
    return estimates.groupBy(*keys).agg(F.count("q").alias("m"), F.avg("q").alias("q_m"), F.var_samp("q").alias("b_m"), F.avg("u").alias("u_m"))


def usable(estimates: DataFrame) -> DataFrame:
    """Estimates that exist and whose variance is not huge."""
    return estimates.filter(F.col("q").isNotNull() & (F.col("u") < HUGE_VARIANCE))


def combined(estimates: DataFrame, keys: Sequence[str], all_keys: DataFrame | None = None) -> DataFrame:
    """Aggregates of the usable estimates; keys without any stay, with nulls."""
    agg = aggregates(usable(estimates), keys)
    return agg if all_keys is None else all_keys.join(agg, list(keys), "left")


def total_variance(agg: DataFrame, n: Column | float | None = None, n_orig: Column | float | None = None) -> DataFrame:
    """Add `t_m`, `df`, and with n, n_orig also `t_nn`, never negative."""
    inflated = (1 + 1 / F.col("m")) * F.col("b_m")
    t = inflated - F.col("u_m")
    out = agg.withColumn("t_m", t).withColumn("df", (F.col("m") - 1) * F.pow(1 - F.col("u_m") / F.nullif(inflated, F.lit(0.0)), 2))
    if n is None:
        return out
    part = (n if isinstance(n, Column) else F.lit(float(n))) / (n_orig if isinstance(n_orig, Column) else F.lit(float(n_orig)))
    return out.withColumn("t_nn", F.when(F.col("t_m") > 0, F.col("t_m")).otherwise(part * F.col("u_m")))


def intervals(totals: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Each row once per level with `low`, `high` (null when the variance is negative) and, if `t_nn` is there, `nn_low`, `nn_high`."""
    wide = totals.withColumn("level", F.explode(F.lit([float(v) for v in levels]))).withColumn("__t", t_halfwidth("level", "df"))
    half = F.col("__t") * F.sqrt(F.when(F.col("t_m") >= 0, F.col("t_m")))
    finite = lambda c: F.when(~F.isnan(c), c)
    out = wide.withColumn("low", finite(F.col("q_m") - half)).withColumn("high", finite(F.col("q_m") + half))
    if "t_nn" in totals.columns:
        nn = F.col("__t") * F.sqrt("t_nn")
        out = out.withColumn("nn_low", finite(F.col("q_m") - nn)).withColumn("nn_high", finite(F.col("q_m") + nn))
    return out.drop("__t")


def against_truth(ranges: DataFrame, truth: str = "true_value") -> DataFrame:
    """Width of each interval and whether it holds the true value, both variants; a missing interval holds nothing."""
    def one(df: DataFrame, low: str, high: str, prefix: str) -> DataFrame:
        inside = F.coalesce(F.col(truth).between(F.col(low), F.col(high)), F.lit(False))
        return df.withColumn(f"{prefix}width", F.col(high) - F.col(low)).withColumn(f"{prefix}contains", inside)

    out = one(ranges, "low", "high", "")
    return one(out, "nn_low", "nn_high", "nn_") if "nn_low" in ranges.columns else out


def coverage(records: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Share of intervals that hold the true value, mean width, how many."""
    return records.groupBy(*keys).agg(
        F.avg(F.col(f"{prefix}contains").cast("int")).alias("coverage"), F.avg(f"{prefix}width").alias("mean_width"), F.count("*").alias("n"))
