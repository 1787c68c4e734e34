"""Clique trees: column sets of any shape, cycles included, without a table over the whole domain.

Column sets are merged into bags whose columns form a tree. A bag's table is small; the whole domain is never enumerated. One
pass towards the root and one back give the log normaliser and the marginal of every bag. Covariances of statistics follow
from the marginals alone: a cell's joint table with its own bag is handed on from bag to bag, for many cells at once, and
blocks of cells are separate Spark tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.operators.domain import Domain
from tallyveil.operators.factors import elimination_order
from tallyveil.operators.marginals import Clique

MAX_BAG_CELLS = 1 << 22  # cells of one bag's table; column sets that need a larger one raise before anything is measured
BLOCK_CELLS = 1 << 24  # table cells that one task hands on from bag to bag
JITTER = 1e-12


@dataclass(frozen=True)
class CliqueTree:
    """Bags in an order in which parents come first; `home[i]` is the bag that holds column set i."""

    domain: Domain
    bags: tuple[Clique, ...]
    parent: tuple[int, ...]
    home: tuple[int, ...]

    @staticmethod
    def of(cliques: Sequence[Clique], domain: Domain, max_cells: int = MAX_BAG_CELLS) -> "CliqueTree":
        """Columns that are in no set get a bag of their own and stay uniform."""
        place = {c: i for i, c in enumerate(domain.columns)}
        near = {c: set() for c in domain.columns}
        for q in cliques:
            for c in q:
                near[c] |= set(q) - {c}
        found: list[frozenset] = []
        for c in elimination_order([(c,) for c in domain.columns] + [tuple(q) for q in cliques]):
            around = near.pop(c)
            bag = frozenset(around | {c})
            for x in around:
                near[x] = (near[x] | around) - {x, c}
            if not any(bag <= other for other in found):
                found.append(bag)
        bags = [tuple(sorted(b, key=place.get)) for b in found]
        for b in bags:
            if domain.cells(b) > max_cells:
                raise ValueError(f"the column sets meet in {b}, a table of {domain.cells(b)} cells; more than {max_cells}")
        order, parent = [0], [-1]
        while len(order) < len(bags):  # the neighbour that shares most columns with a bag in the tree comes next
            shared, _, at, new = max((len(found[i] & found[j]), -j, i, j) for i in order for j in range(len(bags)) if j not in order)
            parent.append(order.index(at))
            order.append(new)
        home = tuple(next(k for k, j in enumerate(order) if set(q) <= found[j]) for q in cliques)
        return CliqueTree(domain, tuple(bags[j] for j in order), tuple(parent), home)

    def separator(self, bag: int) -> Clique:
        """Columns that a bag shares with its parent."""
        return () if self.parent[bag] < 0 else tuple(c for c in self.bags[bag] if c in self.bags[self.parent[bag]])

    def shape(self, columns: Sequence[str]) -> tuple[int, ...]:
        return tuple(self.domain.sizes(columns)) if columns else ()

    @property
    def cells(self) -> int:
        return sum(self.domain.cells(b) for b in self.bags)

    # ---- drawing order, as the sampler needs it

    @property
    def order(self) -> tuple[str, ...]:
        return tuple(c for c, _, _ in self.steps())

    def given(self, column: str) -> Clique:
        """Columns drawn earlier on which a column's distribution depends."""
        return next(g for c, g, _ in self.steps() if c == column)

    def steps(self) -> list[tuple[str, Clique, int]]:
        """(column, columns it depends on, bag) in drawing order."""
        out = []
        for k, bag in enumerate(self.bags):
            known = list(self.separator(k))
            for c in bag:
                if c not in known:
                    out.append((c, tuple(x for x in bag if x in known), k))
                    known.append(c)
        return out


def _axes(columns: Sequence[str], keep: Sequence[str]) -> tuple[int, ...]:
    """Axes to sum out, counted from the end so that leading batch axes do not matter."""
    return tuple(i - len(columns) for i, c in enumerate(columns) if c not in keep)


def _spread(table: np.ndarray, columns: Sequence[str], into: Sequence[str]) -> np.ndarray:
    """A table over `columns` (in the order of `into`) with axes of length 1 for the others; leading axes stay."""
    lead = table.shape[:table.ndim - len(columns)]
    sizes = dict(zip(columns, table.shape[len(lead):]))
    return table.reshape(*lead, *[sizes.get(c, 1) for c in into])


def _log_sum(table: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    if not axes:
        return table
    top = table.max(axis=axes, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(table - top).sum(axis=axes, keepdims=True)) + top).squeeze(axis=axes)


def marginals(tree: CliqueTree, potentials: Sequence[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """Log normaliser and the marginal table of every bag, from log tables of the bags."""
    up, sent = list(potentials), [None] * len(tree.bags)
    for k in range(len(tree.bags) - 1, 0, -1):
        above = tree.parent[k]
        sent[k] = _log_sum(up[k], _axes(tree.bags[k], tree.separator(k)))
        up[above] = up[above] + _spread(sent[k], tree.separator(k), tree.bags[above])
    z = float(_log_sum(up[0], _axes(tree.bags[0], ())))
    out = [np.exp(up[0] - z)]
    for k in range(1, len(tree.bags)):
        sep = tree.separator(k)
        mass = out[tree.parent[k]].sum(axis=_axes(tree.bags[tree.parent[k]], sep))
        level = np.where(np.isfinite(sent[k]), sent[k], 0.0)
        out.append(np.exp(up[k] - _spread(level, sep, tree.bags[k])) * _spread(mass, sep, tree.bags[k]))
    return z, out


class Statistics:
    """The statistics of a maximum-entropy model over a clique tree: one parameter for each listed cell of each column set."""

    def __init__(self, tree: CliqueTree, cliques: Sequence[Clique], ids: Sequence[Sequence[int]]):
        self.tree, self.cliques = tree, [tuple(q) for q in cliques]
        self.cells = [np.flatnonzero(np.asarray(i) >= 0) for i in ids]
        self.query = [np.asarray(i)[c] for i, c in zip(ids, self.cells)]
        self.size = sum(map(len, self.query))

    def potentials(self, lam: Sequence[float]) -> list[np.ndarray]:
        lam = np.asarray(lam, float)
        out = [np.zeros(self.tree.shape(b)) for b in self.tree.bags]
        for q, home, cells, query in zip(self.cliques, self.tree.home, self.cells, self.query):
            table = np.zeros(math.prod(self.tree.shape(q)))
            table[cells] = lam[query]
            ordered = tuple(c for c in self.tree.bags[home] if c in q)
            table = table.reshape(self.tree.shape(q)).transpose([q.index(c) for c in ordered])
            out[home] = out[home] + _spread(table, ordered, self.tree.bags[home])
        return out

    def read(self, tables: Sequence[np.ndarray], batch: int | None = None) -> np.ndarray:
        """Values of all statistics under bag tables; with `batch`, one row for each leading index."""
        out = np.zeros((batch or 1, self.size))
        for q, home, cells, query in zip(self.cliques, self.tree.home, self.cells, self.query):
            bag = self.tree.bags[home]
            summed = tables[home].sum(axis=_axes(bag, q))
            ordered = [c for c in bag if c in q]
            lead = summed.ndim - len(ordered)
            summed = summed.transpose([*range(lead), *[lead + ordered.index(c) for c in q]])
            out[:, query] = summed.reshape(batch or 1, -1)[:, cells]
        return out if batch else out[0]

    def second_moments(self, beliefs: Sequence[np.ndarray], which: Sequence[int]) -> np.ndarray:
        """Expected products of the given statistics with all statistics."""
        tree, out = self.tree, np.zeros((len(which), self.size))
        links: list[list[int]] = [[] for _ in tree.bags]
        for k in range(1, len(tree.bags)):
            links[k].append(tree.parent[k])
            links[tree.parent[k]].append(k)
        wanted = np.full(self.size, -1)
        wanted[list(which)] = np.arange(len(which))
        step = max(1, (1 << 21) // max(b.size for b in beliefs))
        for q, home, cells, query in zip(self.cliques, tree.home, self.cells, self.query):
            here = np.flatnonzero(wanted[query] >= 0)
            for at in range(0, len(here), step):
                some = here[at:at + step]
                bag, shape = tree.bags[home], tree.shape(q)
                codes = dict(zip(q, np.unravel_index(cells[some], shape)))
                mask = np.ones((len(some), *[1] * len(bag)), bool)
                for axis, c in enumerate(bag):
                    if c in codes:
                        hit = np.arange(tree.domain.size(c))[None, :] == codes[c][:, None]
                        mask = mask & hit.reshape(len(some), *[-1 if a == axis else 1 for a in range(len(bag))])
                tables: list[np.ndarray | None] = [None] * len(beliefs)
                tables[home] = beliefs[home] * mask
                queue = [home]
                while queue:
                    k = queue.pop()
                    for j in links[k]:
                        if tables[j] is None:
                            shared = tree.separator(j) if tree.parent[j] == k else tree.separator(k)
                            told = tables[k].sum(axis=_axes(tree.bags[k], shared))
                            mass = beliefs[j].sum(axis=_axes(tree.bags[j], shared))
                            ratio = np.divide(told, mass, out=np.zeros_like(told), where=mass > 0)
                            tables[j] = beliefs[j] * _spread(ratio, shared, tree.bags[j])
                            queue.append(j)
                out[wanted[query[some]]] = self.read(tables, len(some))
        return out

    def moments(self, spark: SparkSession, lam: Sequence[float]) -> tuple[float, np.ndarray, "callable"]:
        """Log normaliser, means, and a function that gives the covariance; its blocks of rows are Spark tasks."""
        z, beliefs = marginals(self.tree, self.potentials(lam))
        mean = self.read(beliefs)

        def covariance() -> np.ndarray:
            blocks = max(1, math.ceil(self.size * self.tree.cells / BLOCK_CELLS))
            if blocks == 1:
                second = self.second_moments(beliefs, range(self.size))
            else:
                second = np.zeros((self.size, self.size))
                table = _moment_rows(spark, self, list(map(float, lam)), blocks).toArrow()
                second[table.column("i").to_numpy()] = table.column("row").combine_chunks().flatten().to_numpy().reshape(-1, self.size)
            return (second + second.T) / 2 - np.outer(mean, mean) + np.eye(self.size) * JITTER

        return z, mean, covariance


def _moment_rows(spark: SparkSession, statistics: Statistics, lam: list[float], blocks: int) -> DataFrame:
    """(i, row): expected products of statistic i with all others, blocks of statistics in tasks of their own."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beliefs = None
        for b in batches:
            for ids in np.array_split(b["id"].to_numpy(), max(1, len(b) // 64)):
                if len(ids):
                    beliefs = beliefs or marginals(statistics.tree, statistics.potentials(lam))[1]
                    yield pd.DataFrame({"i": ids, "row": list(statistics.second_moments(beliefs, ids))})

    return spark.range(0, statistics.size, 1, blocks).mapInPandas(work, "i long, row array<double>")


def model_moments(spark: SparkSession, statistics: Statistics, lam: Sequence[float]) -> DataFrame:
    """(i, j, mean_i, cov) of all pairs of statistics, by messages."""
    _, beliefs = marginals(statistics.tree, statistics.potentials(lam))
    mean = [float(v) for v in statistics.read(beliefs)]
    blocks = max(1, math.ceil(statistics.size * statistics.tree.cells / BLOCK_CELLS))
    rows = _moment_rows(spark, statistics, list(map(float, lam)), blocks).select("i", F.posexplode("row").alias("j", "second"))
    at = F.lit(mean)
    cov = F.col("second") - F.get(at, F.col("i").cast("int")) * F.get(at, F.col("j")) + F.when(F.col("i") == F.col("j"), JITTER).otherwise(0.0)
    return rows.select("i", F.col("j").cast("long").alias("j"), F.get(at, F.col("i").cast("int")).alias("mean_i"), cov.alias("cov"))


def step_conditionals(statistics: Statistics, lambdas: DataFrame) -> DataFrame:
    """(draw_id, col, parent_code, code, p, cum): each column given the columns it depends on, for every draw of parameters.

    `parent_code` numbers the codes of the given columns, first column slowest. Draws are spread over tasks; a draw's
    parameters are one small row. What has no mass is uniform.
    """
    tree = statistics.tree

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for draw, lam in zip(b["draw_id"], b["lams"]):
                _, beliefs = marginals(tree, statistics.potentials(lam))
                for column, given, k in tree.steps():
                    bag = tree.bags[k]
                    joint = beliefs[k].sum(axis=_axes(bag, (*given, column)))
                    ordered = [c for c in bag if c in (*given, column)]
                    joint = joint.transpose([ordered.index(c) for c in (*given, column)]).reshape(-1, tree.domain.size(column))
                    mass = joint.sum(axis=1, keepdims=True)
                    p = np.divide(joint, mass, out=np.full_like(joint, 1 / joint.shape[1]), where=mass > 0)
                    yield pd.DataFrame({"draw_id": draw, "col": column, "parent_code": np.repeat(np.arange(len(p)), p.shape[1]),
                                        "code": np.tile(np.arange(p.shape[1]), len(p)), "p": p.ravel(), "cum": p.cumsum(axis=1).ravel()})

    vectors = lambdas.groupBy("draw_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "lam"))), lambda s: s["lam"]).alias("lams"))
    return vectors.mapInPandas(work, "draw_id long, col string, parent_code long, code int, p double, cum double")
