"""Tables about runs: durations, fields, parameter grids, results side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.text import pairs_key_text, run_key
from tallyveil.operators.marginals import Clique
from tallyveil.sources.tables import combine

ORIGINAL = "Inf"  # fixed value: the epsilon label of results on original data


def durations(log: DataFrame, start: str = "start", stop: str = "stop", tasks: Sequence[str] | None = None) -> DataFrame:
    """Add `seconds`; keep the listed tasks."""
    kept = log.filter(F.col("task").isin(list(tasks))) if tasks is not None else log
    return kept.withColumn("seconds", F.timestamp_diff("MICROSECOND", F.col(start), F.col(stop)) / F.lit(1e6))


def upsert_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Fields of runs by id: new values overwrite, missing ones keep the old, new runs and columns are added."""
    columns = [c for c in old.columns if c != key] + [c for c in new.columns if c != key and c not in old.columns]
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def pick(c: str) -> Column:
        sides = [F.col(f"{t}.{c}") for t, df in (("b", new), ("a", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return joined.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *[pick(c) for c in columns])


def latest_fields(log: DataFrame, key: str, field: str, value: str, order: str) -> DataFrame:
    """The same from a long log (key, field, value, order): last value of each field."""
    return log.groupBy(key, field).agg(F.max_by(value, order).alias(value))


def _each(values: Sequence, name: str) -> Column:
    return F.explode(F.lit(list(values))).alias(name)


def parameter_grid(datasets: DataFrame, required: Sequence[Sequence[Clique]], epsilons: Sequence[float], repeats: int) -> DataFrame:
    """One row per dataset, required pairs, epsilon and repeat, with a key and an id.

    `datasets` has (dataset_name, n); delta is n^-2. The grid is spread from each dataset row.
    """
    queries = F.explode(F.lit([pairs_key_text(p) for p in required])).alias("query")
    grid = datasets.select("*", queries).select("*", _each([float(e) for e in epsilons], "epsilon"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    key = run_key("dataset_name", "epsilon", "query")
    return grid.withColumn("run_key", key).withColumn("delta", 1.0 / (F.col("n") * F.col("n"))).withColumn(
        "run_id", F.md5(F.concat_ws("_", "run_key", F.col("repeat").cast("string"))))


def pruning_grid(datasets: DataFrame, pairs: Sequence[Clique], epsilons: Sequence[float]) -> DataFrame:
    """One row per dataset, removed pair and epsilon; `pairs_left` counts what stays."""
    grid = datasets.select("*", _each(["+".join(p) for p in pairs], "missing_query")).select("*", _each([float(e) for e in epsilons], "epsilon"))
    return grid.withColumn("pairs_left", F.lit(len(pairs) - 1)).withColumn("run_key", run_key("dataset_name", "epsilon", "missing_query"))


def with_originals(synthetic: DataFrame, original: DataFrame) -> DataFrame:
    """Append results on original data, marked by the epsilon label."""
    return combine([synthetic.withColumn("epsilon", F.col("epsilon").cast("string")), original.withColumn("epsilon", F.lit(ORIGINAL))])


def labelled_union(tables: Mapping[str, DataFrame], label: str = "experiment") -> DataFrame:
    """Tables of several experiments in one, each row with its experiment."""
    return combine([df.withColumn(label, F.lit(name)) for name, df in tables.items()])


def with_extremes(results: DataFrame, key: str, metric: str) -> DataFrame:
    """Each result next to the best and worst of its dataset; one row per dataset is joined back."""
    ends = results.groupBy(key).agg(F.max(metric).alias("best"), F.min(metric).alias("worst"))
    return results.join(ends, key)


def metric_facets(results: DataFrame, dims: Sequence[str], metric: str) -> DataFrame:
    """Mean, sd and count over every combination of the dimensions and their totals (null = all)."""
    return results.cube(*dims).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n"), F.grouping_id().alias("level"))
