"""Weighted tables: one row per value combination with a log weight (column `logw`).

The scope of a table is its other columns. Tables may be of any size; every operation is a join or a
grouped sum with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.operators.domain import Domain, all_rows, rank_cell
from tallyveil.session import cut_lineage

LOGW = "logw"
_STRIDE = 256.0  # exp() of anything inside one stride stays finite


def scope(factor: DataFrame) -> list[str]:
    return [c for c in factor.columns if c != LOGW]


def log_sum_exp(df: DataFrame, keys: Sequence[str], value: str = LOGW, out: str = LOGW) -> DataFrame:
    """log(sum(exp(value))) per key, stable, and summed on the map side.

    Values are first summed inside strides of their exponent (plain partial sums, so a hot key does
    not gather its rows in one task), then the few strides of a key are combined.
    """
    strided = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.floor(F.col(value) / _STRIDE).alias("__s"))
    first = strided.groupBy(*keys, "__s").agg(F.sum(F.exp(F.col("__v") - F.col("__s") * _STRIDE)).alias("__t"))
    logs = first.select(*keys, (F.ln("__t") + F.col("__s") * _STRIDE).alias("__l"))
    top = logs.groupBy(*keys).agg(F.collect_list("__l").alias("__a"))
    peak = F.array_max("__a")
    total = F.aggregate("__a", F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    return top.select(*keys, (peak + F.ln(total)).alias(out))


def from_parameters(domain: Domain, columns: Sequence[str], parameters: DataFrame, spark) -> DataFrame:
    """Table of one column set from parameters (cell, lam); cells without one weigh 0."""
    grid = all_rows(spark, domain, columns)
    joined = grid.join(parameters.select(F.col("cell").alias("cell_id"), "lam"), "cell_id", "left")
    return joined.select(*columns, F.coalesce("lam", F.lit(0.0)).alias(LOGW))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product over the union of the scopes; joined on the shared columns."""
    left, right = scope(a), scope(b)
    shared = [c for c in left if c in right]
    other = b.withColumnRenamed(LOGW, "__w")
    joined = a.join(other, shared) if shared else a.withColumn("__k", F.lit(0)).join(other.withColumn("__k", F.lit(0)), "__k")
    return joined.select(*left, *[c for c in right if c not in shared], (F.col(LOGW) + F.col("__w")).alias(LOGW))


def list_product(factors: Sequence[DataFrame]) -> DataFrame:
    if not factors:
        raise ValueError("no factors")
    out = factors[0]
    for f in factors[1:]:
        out = product(out, f)
    return out


def marginalise(factor: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Sum columns out."""
    gone = [columns] if isinstance(columns, str) else list(columns)
    missing = [c for c in gone if c not in scope(factor)]
    if missing:
        raise ValueError(f"columns {missing} are not in the scope")
    return log_sum_exp(factor, [c for c in scope(factor) if c not in gone])


def total(factor: DataFrame) -> DataFrame:
    """One row: the log of the sum of all weights."""
    return log_sum_exp(factor, [])


def project(factor: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the given columns, sum out the rest; columns outside the scope raise."""
    missing = [c for c in columns if c not in scope(factor)]
    if missing:
        raise ValueError(f"columns {missing} are not in the scope")
    return log_sum_exp(factor, columns)


def condition(factor: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value, without that column."""
    return factor.filter(F.col(column) == F.lit(value)).drop(column)


def add_batch(factor: DataFrame, n: int, key: str = "batch") -> DataFrame:
    """The table once per batch number 0..n-1."""
    return factor.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def batch_condition(factor: DataFrame, column: str, values: DataFrame, key: str = "batch") -> DataFrame:
    """Each batch conditioned on its own value; `values` has (key, column)."""
    return factor.join(values.select(key, column), [key, column]).drop(column)


def probabilities(factor: DataFrame, cells: DataFrame) -> DataFrame:
    """Normalised probability of listed cells (`p`); cells carry the scope columns."""
    norm = total(factor).withColumnRenamed(LOGW, "__z")
    hit = cells.join(factor, scope(factor), "left")
    return hit.join(F.broadcast(norm)).withColumn("p", F.coalesce(F.exp(F.col(LOGW) - F.col("__z")), F.lit(0.0))).drop("__z", LOGW)


def elimination_order(scopes: Sequence[Sequence[str]], keep: Sequence[str] = ()) -> list[str]:
    """Columns to sum out, by how many columns they share a table with, fewest first."""
    near: dict[str, set] = {}
    for s in scopes:
        for c in s:
            near.setdefault(c, set()).update(x for x in s if x != c)
    order = []
    while left := [c for c in near if c not in keep]:
        best = min(left, key=lambda c: (len(near[c]), c))
        order.append(best)
        around = near.pop(best)
        for c in around:
            near[c] |= around - {c}
            near[c].discard(best)
    return order


def eliminate(factors: Sequence[DataFrame], keep: Sequence[str]) -> DataFrame:
    """Log weights over `keep`: multiply and sum out one column at a time, so no table spans all columns."""
    pool = list(factors)
    for column in elimination_order([scope(f) for f in pool], keep):
        touching = [f for f in pool if column in scope(f)]
        rest = [f for f in pool if column not in scope(f)]
        pool = rest + [marginalise(list_product(touching), column)]
    out = list_product(pool)
    return project(out, list(keep))


def tree_messages(pairs: Mapping[tuple[str, str], DataFrame], root: str) -> dict[tuple[str, str], DataFrame]:
    """Normalised marginal tables (column `p`) of all pairs of a tree, by two sweeps of messages.

    A message has one row per value of a column; each is written once, since several others build on it.
    """
    near: dict[str, list[str]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    table = lambda a, b: pairs[(a, b)] if (a, b) in pairs else pairs[(b, a)]
    order, parent, stack = [], {root: None}, [root]
    while stack:
        c = stack.pop()
        order.append(c)
        for x in near[c]:
            if x != parent[c]:
                if x in parent:
                    raise ValueError("the pairs form a cycle")
                parent[x] = c
                stack.append(x)
    message: dict[tuple[str, str], DataFrame] = {}

    def gather(c: str, skip: str, base: DataFrame) -> DataFrame:
        for x in near[c]:
            if x != skip:
                base = product(base, message[(x, c)])
        return base

    for c in reversed(order[1:]):
        message[(c, parent[c])] = cut_lineage(marginalise(gather(c, parent[c], table(c, parent[c])), c))
    for c in order[1:]:
        p = parent[c]
        message[(p, c)] = cut_lineage(marginalise(gather(p, c, table(p, c)), p))
    out = {}
    for a, b in pairs:
        belief = gather(b, a, gather(a, b, pairs[(a, b)]))
        norm = total(belief).withColumnRenamed(LOGW, "__z")
        out[(a, b)] = belief.join(F.broadcast(norm)).select(a, b, F.exp(F.col(LOGW) - F.col("__z")).alias("p"))
    return out


def cell_column(columns: Sequence[str], domain: Domain):
    """Cell number of a table's rows."""
    return rank_cell(list(columns), domain.sizes(columns))
