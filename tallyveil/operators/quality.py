"""How synthetic tables compare with the original, which columns depend on each other, and how draws behave."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.special import chi2_tail, t_two_sided
from tallyveil.operators.domain import Domain
from tallyveil.operators.marginals import Clique, all_pairs, count_cells, pair_sides
from tallyveil.session import cut_lineage

RANK_ACCURACY = 10_000

# ---------------------------------------------------------------- marginals side by side


def value_count_table(original: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(kind, dataset_id, col, value, n); the original has a null dataset_id."""
    def counts(df: DataFrame, keys: list[str]) -> DataFrame:
        long = df.select(*keys, *columns).unpivot(keys, list(columns), "col", "value")
        return long.groupBy(*keys, "col", "value").agg(F.count("*").alias("n"))

    orig = counts(original, []).select(F.lit("original").alias("kind"), F.lit(None).cast("int").alias("dataset_id"), "col", "value", "n")
    return orig.unionByName(counts(synthetic, ["dataset_id"]).select(F.lit("synthetic").alias("kind"), "dataset_id", "col", "value", "n"))


def mean_counts(counts: DataFrame, tables: int | None = None) -> DataFrame:
    """Mean count per value and kind. With `tables`, values a table lacks count as 0."""
    total = F.sum("n") / F.when(F.col("kind") == "synthetic", F.lit(tables)).otherwise(1) if tables else F.avg("n")
    return counts.groupBy("kind", "col", "value").agg(total.alias("mean_n"))


# ---------------------------------------------------------------- chi-square


def chi_square(cells: DataFrame, keys: Sequence[str], row: str, column: str, count: str = "n") -> DataFrame:
    """(keys..., statistic, df, p, first_expected) of contingency tables given by their occurring cells.

    Absent cells contribute their expected count, and expected counts add up to the total, so the grid of
    all cells is never built. With one degree of freedom the counts are moved by up to one half towards
    the expectation; all four gaps of a 2 x 2 table are equal, so any occurring cell tells it.
    """
    seen = cells.filter(F.col(count) > 0).select(*keys, F.col(row).alias("__a"), F.col(column).alias("__b"), F.col(count).alias("__o"))
    rows = seen.groupBy(*keys, "__a").agg(F.sum("__o").alias("__r"))
    cols = seen.groupBy(*keys, "__b").agg(F.sum("__o").alias("__c"))
    shape_r = rows.groupBy(*keys).agg(F.sum("__r").alias("__n"), F.count("*").alias("__nr"), F.sum(1 / F.col("__r")).alias("__ir"), F.min_by("__r", "__a").alias("__r0"))
    shape_c = cols.groupBy(*keys).agg(F.count("*").alias("__nc"), F.sum(1 / F.col("__c")).alias("__ic"), F.min_by("__c", "__b").alias("__c0"))
    shape = _join(shape_r, shape_c, keys)
    full = _join(seen.join(rows, [*keys, "__a"]).join(cols, [*keys, "__b"]), shape.select(*keys, "__n"), keys)
    expected = F.col("__r") * F.col("__c") / F.col("__n")
    gap = F.abs(F.col("__o") - expected)
    sums = full.groupBy(*keys).agg(F.sum(gap * gap / expected - expected).alias("__s"), F.max(gap).alias("__d"))
    df = (F.col("__nr") - 1) * (F.col("__nc") - 1)
    moved = F.greatest(F.col("__d") - 0.5, F.lit(0.0))
    statistic = F.when(df == 0, 0.0).when(df == 1, moved * moved * F.col("__n") * F.col("__ir") * F.col("__ic")).otherwise(F.greatest(F.col("__s") + F.col("__n"), F.lit(0.0)))
    out = _join(sums, shape, keys).select(*keys, df.alias("df"), statistic.alias("statistic"), (F.col("__r0") * F.col("__c0") / F.col("__n")).alias("first_expected"))
    return out.withColumn("p", F.when(F.col("df") == 0, 1.0).otherwise(chi2_tail("statistic", F.greatest(F.col("df"), F.lit(1)).cast("double"))))


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return a.join(b, list(keys))
    return a.withColumn("__one", F.lit(0)).join(b.withColumn("__one", F.lit(0)), "__one").drop("__one")


def pair_chi_square(coded: DataFrame, domain: Domain, pairs: Sequence[Clique] | None = None, rows: str | None = None) -> DataFrame:
    """Chi-square of every column pair from one counting pass: (left_col, right_col, statistic, df, p, first_expected)."""
    chosen = list(pairs) if pairs is not None else all_pairs(domain.columns)
    side = pair_sides(chosen, domain)
    cells = cut_lineage(count_cells(coded, chosen, domain, rows).select("clique_id", *[F.expr(t).alias(c) for c, t in side.items()], "n"))
    return chi_square(cells, ["clique_id", "left_col", "right_col"], "left_code", "right_code").drop("clique_id")


def rank_pairs(scores: DataFrame, score: str, ascending: bool = True) -> DataFrame:
    """Add `place` from 1; ties by pair name. There is one row per column pair."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return scores.withColumn("place", F.row_number().over(W.orderBy(order, "left_col", "right_col")))


def compare_rankings(a: DataFrame, b: DataFrame, score: str) -> DataFrame:
    """Pairs of two rankings side by side: distance of places, relative difference of scores."""
    key = lambda df, tag: df.select(F.least("left_col", "right_col").alias("c1"), F.greatest("left_col", "right_col").alias("c2"),
                                    F.col("place").alias(f"place_{tag}"), F.col(score).alias(f"score_{tag}"))
    both = key(a, "a").join(key(b, "b"), ["c1", "c2"])
    return both.select("c1", "c2", F.abs(F.col("place_a") - F.col("place_b")).alias("distance"),
                       (F.abs(F.col("score_a") - F.col("score_b")) / F.nullif("score_a", F.lit(0.0))).alias("relative_difference"))


def pair_key(left: str, right: str) -> Column:
    """`A+B` with the names in order."""
    return F.array_join(F.array_sort(F.array(left, right)), "+")


def min_max(df: DataFrame, column: str, out: str, digits: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Scale a column to [0, 1] and round; the extremes are one aggregated row (per group) joined back."""
    ends = df.groupBy(*by).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    joined = df.join(ends, list(by)) if by else df.join(F.broadcast(ends))
    scaled = (F.col(column) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return joined.withColumn(out, F.round(scaled, digits)).drop("__lo", "__hi")


def attach_score(runs: DataFrame, scores: DataFrame, run_key: str, score_key: str, score: str) -> DataFrame:
    """Add the score of a key to each run; the score table has one row per key."""
    return runs.join(scores.select(F.col(score_key).alias(run_key), score), run_key, "left")


# ---------------------------------------------------------------- closeness of tables


def moments_close(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], tolerance: float = 0.3) -> DataFrame:
    """(dataset_id, col, mean_gap, std_gap, close): relative differences of means and deviations; null where the original's is 0."""
    def stats(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        row = df.groupBy(*keys).agg(*[f(c).alias(f"{c}|{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
        parts = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"{c}|m").alias(f"m_{tag}"), F.col(f"{c}|s").alias(f"s_{tag}")) for c in columns]))
        return row.select(*keys, parts.alias("p")).select(*keys, "p.*")

    both = stats(synthetic, ["dataset_id"], "syn").join(F.broadcast(stats(original, [], "orig")), "col")
    gap = lambda c: F.try_divide(F.abs(F.col(f"{c}_syn") - F.col(f"{c}_orig")), F.abs(F.col(f"{c}_orig")))
    return both.select("dataset_id", "col", gap("m").alias("mean_gap"), gap("s").alias("std_gap")).withColumn(
        "close", (F.col("mean_gap") <= tolerance) & (F.col("std_gap") <= tolerance))


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each table has that the other lacks (with multiplicity), and `equal`.

    Both sides are counted per distinct row in one grouping, so a row repeated very often stays one group.
    """
    tag = lambda df, x, y: df.select(*a.columns, F.lit(x).alias("__a"), F.lit(y).alias("__b"))
    sums = tag(a, 1, 0).unionAll(tag(b.select(*a.columns), 0, 1)).groupBy(*a.columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    gap = F.col("__a") - F.col("__b")
    out = sums.agg(F.coalesce(F.sum(F.greatest(gap, F.lit(0))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.greatest(-gap, F.lit(0))), F.lit(0)).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(left_col, right_col, cov) of all column pairs from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(x).alias("left_col"), F.lit(y).alias("right_col"), F.col(f"c{i}").alias("cov"))
             for i, (a, b) in enumerate(pairs) for x, y in ({(a, b), (b, a)})]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal-width, left-closed bins between the extremes; the last bin is closed."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    width = (ends["hi"] - ends["lo"]) / bins or 1.0
    place = F.least(F.floor((F.col(column) - F.lit(ends["lo"])) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- draws and traces


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact (keys..., prob, quantile): the smallest value with at least prob * n values up to it.

    A bounded sketch brackets each quantile; a second pass counts what lies below the bracket and the
    distinct values inside it, so no group is ever gathered. A bracket that misses raises.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    reach = 4.0 / RANK_ACCURACY
    ends = [e for p in probs for e in (max(p - reach, 0.0), min(p + reach, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("__v", ends, RANK_ACCURACY).alias("__e"), F.count("*").alias("__n"))
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.get("__e", F.lit(2 * i)).alias("lo"), F.get("__e", F.lit(2 * i + 1)).alias("hi"))
                               for i, p in enumerate(probs)]))
    brackets = sketch.select(*keys, "__n", each.alias("__b")).select(*keys, "__n", "__b.*")
    brackets = brackets.withColumn("__rank", F.greatest(F.ceil(F.col("prob") * F.col("__n")), F.lit(1)))
    near = _join(rows, brackets, keys).filter(F.col("__v") <= F.col("hi"))
    inside = F.when(F.col("__v") >= F.col("lo"), F.col("__v"))  # null stands for everything below
    counts = near.groupBy(*keys, "prob", "__rank", inside.alias("__v")).agg(F.count("*").alias("__c"))
    order = W.partitionBy(*keys, "prob").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = counts.withColumn("__cum", F.sum("__c").over(order)).filter(F.col("__cum") >= F.col("__rank"))
    first = reached.groupBy(*keys, "prob").agg(F.min_by(F.struct("__v"), "__cum").alias("__q"))
    missed = F.raise_error(F.lit("quantile bracket missed")).cast("double")
    return first.select(*keys, "prob", F.when(F.col("__q.__v").isNull(), missed).otherwise(F.col("__q.__v")).alias("quantile"))


def draw_summary(draws: DataFrame, keys: Sequence[str] = ("param",), value: str = "value") -> DataFrame:
    """Per parameter mean, sd, median, 5 % and 95 % points and split R-hat; `draws` has (chain, draw, keys..., value).

    Each chain is cut in two halves; within and between variances come from the per-half sums.
    """
    ends = draws.groupBy(*keys, "chain").agg(F.count("*").alias("__len"), F.min("draw").alias("__d0"))
    cut = draws.join(ends, [*keys, "chain"])
    offset = F.col("draw") - F.col("__d0")
    size = F.call_function("div", F.col("__len"), F.lit(2))
    half = F.when(offset < size, 0).when(offset >= F.col("__len") - size, 1)
    per = cut.withColumn("__half", half).filter("__half IS NOT NULL").groupBy(*keys, "chain", "__half").agg(
        F.avg(value).alias("__m"), F.var_samp(value).alias("__v"), F.count("*").alias("__n"))
    mix = per.groupBy(*keys).agg(F.avg("__v").alias("__w"), F.var_samp("__m").alias("__bn"), F.first("__n").alias("__n"))
    pooled = (F.col("__n") - 1) / F.col("__n") * F.col("__w") + F.col("__bn")
    rhat = mix.select(*keys, F.sqrt(F.try_divide(pooled, F.col("__w"))).alias("r_hat"))
    stats = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    points = order_statistics(draws, keys, value, [0.05, 0.5, 0.95]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.05, "p05"), (0.5, "median"), (0.95, "p95"))])
    return stats.join(points, list(keys)).join(rhat, list(keys))


def trace_stats(trace: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Min, max, mean and population sd of trace columns per key (run, chain)."""
    stats = (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))
    return trace.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in stats])


def normal_density_grid(normals: DataFrame, keys: Sequence[str], mean: str, var: str, low: float, high: float, points: int) -> DataFrame:
    """(keys..., x, density) of normal distributions on a grid."""
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit((high - low) / (points - 1))))
    wide = normals.select(*keys, mean, var, x.alias("x"))
    density = F.exp(-F.pow(F.col("x") - F.col(mean), 2) / (2 * F.col(var))) / F.sqrt(F.lit(2 * math.pi) * F.col(var))
    return wide.select(*keys, "x", density.alias("density"))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation per group with two-sided p: (keys..., r, n, p)."""
    out = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return out.withColumn("p", F.when(F.col("n") > 2, t_two_sided(t, (F.col("n") - 2).cast("double"))))


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, points: int, bandwidth: float, bins: int = 2048) -> DataFrame:
    """(keys..., x, density, standard_normal) of a column on a grid, Gaussian kernel.

    Values are first binned (finely against the bandwidth), so the grid meets bins and not rows.
    """
    span = high - low
    cell = span / bins
    center = (F.floor((F.col(value) - low) / cell) + 0.5) * cell + low
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, center.alias("__c")).agg(F.count("*").alias("__n"))
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(span / (points - 1))))
    wide = counts.withColumn("x", x)
    kernel = F.exp(-F.pow((F.col("x") - F.col("__c")) / bandwidth, 2) / 2) / (bandwidth * math.sqrt(2 * math.pi))
    dens = wide.groupBy(*keys, "x").agg((F.sum(F.col("__n") * kernel) / F.sum("__n")).alias("density"))
    return dens.withColumn("standard_normal", F.exp(-F.col("x") * F.col("x") / 2) / math.sqrt(2 * math.pi))
