"""Generating synthetic rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.functions.keyed import hash_uniform, md5_normal, md5_uniform
from tallyveil.functions.sqltext import ident
from tallyveil.operators.cliquetree import CliqueTree
from tallyveil.operators.domain import Domain, decode, rank_cell, unrank
from tallyveil.operators.numbering import number_rows
from tallyveil.operators.treemodel import DRAWS_AT_ONCE, Tree
from tallyveil.session import broadcast_checked

UNROLL = 64  # columns with at most this many levels compare thresholds one by one in generated code
UNROLL_COLUMNS = 2  # with more columns the generated method would pass 8000 bytes, beyond which the JVM only interprets it
RANGE_CELLS = 4096  # least number of cells in a range of an explicit model
RANGE_ROWS = 200_000  # rows one task looks up
MAX_RANGES = 65_536  # ranges of cells; beyond that they get wider

Uniform = Callable[..., Column]


def code_from(thresholds: str, u: str, levels: int, columns: int = 1) -> Column:
    """Smallest code whose cumulative probability exceeds u; the last code takes the rest. `columns` are drawn in the same plan.

    The filter ends a generated method, so a plan of many columns consists of methods that the JVM compiles.
    """
    t, x = ident(thresholds), ident(u)
    if levels <= UNROLL and columns <= UNROLL_COLUMNS:
        return F.expr(" + ".join(["0", *[f"int(get({t}, {i}) <= {x})" for i in range(levels - 1)]]))
    return F.expr(f"least(size(filter({t}, v -> v <= {x})), {levels - 1})")


def sample_tree(spark: SparkSession, cpts: DataFrame, tree: Tree | CliqueTree, domain: Domain, n: int, m: int, draws: int = 0,
                salt: str = "sample", uniform: Uniform = hash_uniform, partitions: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """m tables of n rows as one table (dataset_id, row_id, codes...).

    Columns are drawn in tree order. Each step looks up the thresholds of the row's given values by an
    equality join with the conditional tables. Those are small (their size is checked), so they are
    broadcast and the m*n rows never move. With draws > 0 the tables `cpts` carry a `draw_id` and every
    data set takes one draw, chosen with replacement. With `columns` only these and those they depend on are drawn; their values are the same.
    """
    keys = ["draw_id"] if draws else []
    base = spark.range(0, m * n, 1, partitions) if partitions else spark.range(m * n)
    rows = base.select(F.call_function("div", F.col("id"), F.lit(n).cast("long")).cast("int").alias("dataset_id"), (F.col("id") % n).alias("row_id"))
    if draws:  # chosen once for each table, not for each of its rows
        chosen = spark.range(m).select(F.col("id").cast("int").alias("dataset_id")).withColumn("draw_id", F.floor(uniform(f"{salt}/draw", "dataset_id") * draws).cast("int"))
        rows = rows.join(broadcast_checked(chosen, m, 32), "dataset_id")
    wanted = set(domain.columns if columns is None else columns)
    for c in reversed(tree.order):
        if c in wanted:
            wanted.update(tree.given(c))
    order = [c for c in tree.order if c in wanted]
    arrays = cpts.groupBy(*keys, "col", "parent_code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("code", "cum"))), lambda s: s["cum"]).alias("thresholds")).persist()
    for c in order:
        given = tree.given(c)
        levels, parents = domain.size(c), domain.cells(given) if given else 1
        table = arrays.filter(F.col("col") == c).select(*keys, F.col("parent_code").alias("__parent"), F.col("thresholds").alias("__t"))
        table = broadcast_checked(table, max(draws, 1) * parents, 32 + 8 * levels)
        lookup = rows.withColumn("__parent", rank_cell(given, domain.sizes(given)) if given else F.lit(0))
        joined = lookup.join(table, [*keys, "__parent"])
        rows = joined.withColumn("__u", uniform(f"{salt}/{c}", "dataset_id", "row_id"))
        rows = rows.withColumn(c, code_from("__t", "__u", levels, len(order))).drop("__parent", "__t", "__u")
    return rows.select("dataset_id", "row_id", *(["draw_id"] if draws else []), *[c for c in domain.columns if columns is None or c in columns])


def sample_counts(cpts: DataFrame, tree: Tree | CliqueTree, domain: Domain, n: int, seed: int = 0) -> DataFrame:
    """One table of n rows from every draw, as distinct rows with their number: (dataset_id, codes..., rows).

    Splits n by multinomial draws, column after column, so a table costs its distinct rows whatever n is; that has the law of
    n rows drawn one by one. Some draws together are one group with a random source of its own.
    """
    columns = domain.columns

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        draws, place = np.unique(frame["draw_id"].to_numpy(np.int64), return_inverse=True)
        names, parent, code, p = frame["col"].to_numpy(), frame["parent_code"].to_numpy(np.int64), frame["code"].to_numpy(np.int64), frame["p"].to_numpy()
        source = np.random.default_rng([seed, int(draws[0])])
        codes, draw, number = {}, np.arange(len(draws)), np.full(len(draws), n, np.int64)
        for c in tree.order:
            mine, given = names == c, tree.given(c)
            table = np.zeros((len(draws), domain.cells(given) if given else 1, domain.size(c)))
            table[place[mine], parent[mine], code[mine]] = p[mine]
            at = np.zeros(len(number), np.int64)
            for g in given:
                at = at * domain.size(g) + codes[g]
            chance = table[draw, at]
            split = source.multinomial(number, chance / chance.sum(axis=1, keepdims=True))
            row, level = np.nonzero(split)
            codes = {k: v[row] for k, v in codes.items()} | {c: level}
            draw, number = draw[row], split[row, level]
        return pd.DataFrame({"dataset_id": draws[draw], **{c: codes[c].astype(np.int32) for c in columns}, "rows": number})

    shape = ", ".join(["dataset_id long", *[f"{ident(c)} int" for c in columns], "rows long"])
    return cpts.groupBy(F.call_function("div", F.col("draw_id").cast("long"), F.lit(DRAWS_AT_ONCE)).alias("block")).applyInPandas(work, shape)


def generate(spark: SparkSession, cpts: DataFrame, tree: Tree, domain: Domain, n: int, m: int, draws: int = 0,
             columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """m labelled synthetic tables in one DataFrame with `dataset_id`; with `columns` just these of their columns."""
    shown = domain if columns is None else domain.only([c for c in domain.columns if c in columns])
    return decode(sample_tree(spark, cpts, tree, domain, n, m, draws, columns=columns, **kw), shown)


def sample_explicit(spark: SparkSession, probabilities: DataFrame, domain: Domain, n: int, salt: str = "explicit",
                    uniform: Uniform = md5_uniform, range_cells: int = RANGE_CELLS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """n rows by inverse cumulative probability over the whole domain; `probabilities` has (cell_id, p).

    Cells are cut into ranges of their number. Only the sums of the ranges come to the driver, at most MAX_RANGES of them; they
    tell each row's uniform its range, and each range searches its own cells. A range that expects more than `range_rows` rows is
    searched by several tasks, so a cell that holds most of the mass does not gather its rows in one.
    """
    width = max(range_cells, -(-domain.cells() // MAX_RANGES))
    cells = probabilities.filter("p > 0").select("cell_id", "p", F.call_function("div", F.col("cell_id"), F.lit(width)).alias("__range"))
    sums = cells.groupBy("__range").agg(F.sum("p").alias("p")).toArrow().sort_by("__range")
    ids, mass = sums.column("__range").to_numpy(), sums.column("p").to_numpy()
    if not len(ids):
        raise ValueError("no cell has a probability above 0")
    ends = np.cumsum(mass)
    shares = np.maximum(1, np.ceil(n * mass / ends[-1] / range_rows)).astype(np.int64)
    starts = ends - mass
    ranges = spark.createDataFrame(pd.DataFrame({"__range": ids, "__low": starts, "__shares": shares}), "__range long, __low double, __shares long")
    cells = cells.join(broadcast_checked(ranges, len(ids), 64), "__range").select(
        "__range", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__shares") - 1)).alias("__share"), "cell_id", "p", "__low")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.minimum(np.searchsorted(ends, b["u"].to_numpy(), side="right"), len(ends) - 1)
            yield pd.DataFrame({"__range": ids[at], "__share": b["row_id"].to_numpy() % shares[at], "row_id": b["row_id"], "u": b["u"]})

    def search(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"row_id": [], "cell_id": []})
        part = part.sort_values("cell_id")
        t = part["__low"].iloc[0] + np.cumsum(part["p"].to_numpy())
        at = np.minimum(np.searchsorted(t, rows["u"].to_numpy(), side="right"), len(t) - 1)
        return pd.DataFrame({"row_id": rows["row_id"].to_numpy(), "cell_id": part["cell_id"].to_numpy()[at]})

    by = ["__range", "__share"]
    keyed = spark.range(n).select(F.col("id").alias("row_id"), uniform(salt, "id").alias("u"))
    placed = keyed.mapInPandas(place, "__range long, __share long, row_id long, u double")
    hit = placed.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(search, "row_id long, cell_id long")
    codes = unrank("cell_id", domain.sizes())
    return hit.select("row_id", *[c.alias(name) for c, name in zip(codes, domain.columns)])


def jitter(column: str, scale: float, *keys: str, salt: str = "jitter") -> Column:
    """Numeric column plus Gaussian noise."""
    return F.col(column) + F.lit(scale) * md5_normal(salt, *keys)


def sample_rows(df: DataFrame, key: str, k: int, salt: str = "rows") -> DataFrame:
    """k rows with replacement, exactly k: keyed row numbers joined to the numbered table.

    How often a row was drawn is counted first, so the join is on unique numbers.
    """
    numbered = number_rows(df, key, "__no", start=0)
    n = df.count()
    drawn = df.sparkSession.range(k).select(F.floor(md5_uniform(salt, "id") * n).alias("__no")).groupBy("__no").agg(F.count("*").alias("__times"))
    hit = numbered.join(drawn, "__no").drop("__no")
    return hit.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__times")
