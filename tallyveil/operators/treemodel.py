"""Tree-shaped model: conditional tables from (noisy) pair counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.keyed import md5_normal
from tallyveil.operators.domain import Domain
from tallyveil.operators.marginals import Clique


DRAWS_AT_ONCE = 50  # draws of one group


@dataclass(frozen=True)
class Tree:
    """Columns in drawing order with the parent of each (None for a root) and the pair that links them."""

    order: tuple[str, ...]
    parent: dict[str, str | None]
    pair: dict[str, int]

    def given(self, column: str) -> tuple[str, ...]:
        """The column whose code a column's distribution depends on, if any."""
        return () if self.parent[column] is None else (self.parent[column],)

    @staticmethod
    def of(pairs: Sequence[Clique], columns: Sequence[str], partly: bool = False) -> "Tree":
        """`partly`: only cycles raise; columns in no pair are for the pairs still to come."""
        near: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
        for i, (a, b) in enumerate(pairs):
            near[a].append((b, i))
            near[b].append((a, i))
        order, parent, pair = [], {}, {}
        for root in columns:
            if root in parent:
                continue
            if not near[root] and not partly:
                raise ValueError(f"column {root!r} is in no pair")
            parent[root], queue = None, [root]
            pair[root] = near[root][0][1] if near[root] else -1
            while queue:
                c = queue.pop(0)
                order.append(c)
                for x, i in near[c]:
                    if i == pair.get(c) and parent[c] == x:
                        continue
                    if x in parent:
                        raise ValueError("the pairs form a cycle; use the explicit model")
                    parent[x], pair[x] = c, i
                    queue.append(x)
        return Tree(tuple(order), parent, pair)


def conditionals(cells: DataFrame, pairs: Sequence[Clique], domain: Domain, tree: Tree,
                 value: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """(by..., col, parent_code, code, p, cum) of every column from zero-filled pair counts.

    Counts are clipped at 0. A parent value without mass takes the column's own distribution.
    """
    side = F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.lit(tree.pair[c]).alias("pair"), F.lit(tree.parent[c] is None).alias("root"),
                 F.lit(pairs[tree.pair[c]].index(c) == 0).alias("first"),
                 F.lit(domain.size(pairs[tree.pair[c]][1])).alias("width")) for c in tree.order]))
    table = cells.select(*by, "clique_id", "cell", F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("x"), side.alias("s"))
    used = table.filter(F.col("s.pair") == F.col("clique_id"))
    a = F.call_function("div", F.col("cell"), F.col("s.width")).cast("int")
    b = (F.col("cell") % F.col("s.width")).cast("int")
    own, other = F.when(F.col("s.first"), a).otherwise(b), F.when(F.col("s.first"), b).otherwise(a)
    flat = used.select(*by, F.col("s.col").alias("col"), F.when(F.col("s.root"), 0).otherwise(other).alias("parent_code"), own.alias("code"), "x")
    sums = flat.groupBy(*by, "col", "parent_code", "code").agg(F.sum("x").alias("x"))
    per_col, per_parent = W.partitionBy(*by, "col"), W.partitionBy(*by, "col", "parent_code")
    own_share = F.sum("x").over(W.partitionBy(*by, "col", "code")) / F.sum("x").over(per_col)
    level = F.lit(1.0) / F.count("*").over(per_parent)
    mass = F.sum("x").over(per_parent)
    p = F.when(mass > 0, F.col("x") / mass).when(F.sum("x").over(per_col) > 0, own_share).otherwise(level)
    with_p = sums.select(*by, "col", "parent_code", "code", p.alias("p"))
    cum = F.sum("p").over(per_parent.orderBy("code").rowsBetween(W.unboundedPreceding, W.currentRow))
    return with_p.withColumn("cum", cum)


def project(cells: DataFrame, pairs: Sequence[Clique], domain: Domain, n: float, value: str = "y") -> DataFrame:
    """Noisy pair counts moved to non-negative ones that sum to n per pair: (clique_id, cell, `value`).

    First the least change that gives all pairs of a column the same counts of it: the precision-weighted mean of what each
    pair says. Then the nearest table without negative cells, where one level is taken off all cells and the rest is cut;
    so noise in empty cells is not added up, as it is by clipping.
    """
    info = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(domain.size(b)).alias("width")) for a, b in pairs]), F.col("clique_id") + 1)
    by = W.partitionBy("clique_id")
    y = F.col(value).cast("double")
    level = cells.select("clique_id", "cell", (y + (F.lit(float(n)) - F.sum(y).over(by)) / F.count("*").over(by)).alias("x"), info.alias("i"))
    level = level.select("clique_id", "cell", "x", F.col("i.a").alias("a"), F.col("i.b").alias("b"),
                         F.call_function("div", F.col("cell"), F.col("i.width")).cast("int").alias("code_a"), (F.col("cell") % F.col("i.width")).cast("int").alias("code_b"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("col"), F.col("code_a").alias("code")), F.struct(F.col("b").alias("col"), F.col("code_b").alias("code"))))
    margins = level.select("clique_id", "x", sides.alias("s")).groupBy("clique_id", "s.col", "s.code").agg(F.sum("x").alias("m"), F.count("*").alias("w"))
    same = W.partitionBy("col", "code")
    shared = F.sum(F.col("m") / F.col("w")).over(same) / F.sum(F.lit(1.0) / F.col("w")).over(same)
    shift = margins.select("clique_id", "col", "code", ((shared - F.col("m")) / F.col("w")).alias("shift"))
    for side in "ab":
        moves = shift.select("clique_id", F.col("col").alias(side), F.col("code").alias(f"code_{side}"), F.col("shift").alias(f"shift_{side}"))
        level = level.join(moves, ["clique_id", side, f"code_{side}"])
    even = level.select("clique_id", "cell", (F.col("x") + F.col("shift_a") + F.col("shift_b")).alias("x"))
    down = by.orderBy(F.desc("x"), "cell")
    off = (F.sum("x").over(down.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.lit(float(n))) / F.row_number().over(down)
    return even.withColumn("off", off).select("clique_id", "cell", F.greatest(F.col("x") - F.max("off").over(by), F.lit(0.0)).alias(value))


def perturb(cells: DataFrame, draws: int, sigma: float, value: str = "y", salt: str = "draws") -> DataFrame:
    """Cell tables per draw around the released counts: (draw_id, clique_id, cell, n).

    Each draw has the variance of the release noise and of the sampling noise of a cell of n rows, so tables generated
    from different draws vary as much as the data is uncertain. The factors are log-normal with mean 1: counts stay
    non-negative and keep their mean, and an empty cell stays empty.
    """
    many = cells.withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    by = W.partitionBy("draw_id", "clique_id")
    base = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    share = F.coalesce(F.try_divide(base, F.sum(base).over(by)), F.lit(0.0))
    spread = F.ln(1 + F.try_divide(F.lit(float(sigma * sigma)) + base * (1 - share), base * base))
    factor = F.exp(F.sqrt(spread) * md5_normal(salt, "draw_id", "clique_id", "cell") - spread / 2)
    return many.withColumn("n", F.when(base * base > 0, base * factor).otherwise(0.0)).select("draw_id", "clique_id", "cell", "n")


def agree(tables: Sequence[np.ndarray], pairs: Sequence[Clique], n: float, rounds: int = 400) -> list[np.ndarray]:
    """The nearest tables without negative cells in which all pairs of a column have the same counts of it and sum to n.

    Tables may have leading axes, for many draws at once. Alternating projections (Dykstra): onto equal margins and the total,
    and onto non-negative cells. What the last round leaves over is removed by scaling rows and columns to the agreed margins,
    so those hold to rounding.
    """
    def margins(now):
        """Precision-weighted mean of what the pairs say about each column."""
        said: dict[str, list] = {}
        for (a, b), t in zip(pairs, now):
            said.setdefault(a, []).append((t.sum(axis=-1), t.shape[-1]))
            said.setdefault(b, []).append((t.sum(axis=-2), t.shape[-2]))
        return {c: sum(m / w for m, w in each) / sum(1 / w for _, w in each) for c, each in said.items()}

    size, now = max(n, 1), [np.asarray(t, float) for t in tables]
    left = [np.zeros_like(t) for t in now]
    for _ in range(rounds):
        even = [t + (n - t.sum(axis=(-2, -1), keepdims=True)) / (t.shape[-1] * t.shape[-2]) for t in now]
        agreed = margins(even)
        even = [t + ((agreed[a] - t.sum(axis=-1)) / t.shape[-1])[..., :, None] + ((agreed[b] - t.sum(axis=-2)) / t.shape[-2])[..., None, :]
                for (a, b), t in zip(pairs, even)]
        now = [np.maximum(t + r, 0) for t, r in zip(even, left)]
        left = [t + r - x for t, r, x in zip(even, left, now)]
        if max(np.abs(x - t).max() for x, t in zip(now, even)) <= 1e-6 * size:
            break
    now = [t + 1e-9 * size / (t.shape[-1] * t.shape[-2]) for t in now]  # no row or column without mass
    agreed = {c: np.maximum(m, 0) * n / np.maximum(m.sum(axis=-1, keepdims=True), 1e-300) for c, m in margins(now).items()}
    for i, (a, b) in enumerate(pairs):
        t = now[i]
        for _ in range(1000):
            t = t * (agreed[a] / t.sum(axis=-1))[..., :, None]
            t = t * (agreed[b] / t.sum(axis=-2))[..., None, :]
            if np.abs(t.sum(axis=-1) - agreed[a]).max() <= 1e-11 * size:
                break
        now[i] = t
    return now


def consistent_draws(cells: DataFrame, pairs: Sequence[Clique], domain: Domain, n: float, draws: int, sigma: float,
                     salt: str, value: str = "y", by: Sequence[str] = (), spread: bool = True) -> DataFrame:
    """Cell tables per draw around noisy pair counts: (by..., draw_id, clique_id, cell, n). Without `spread`, the agreed tables.

    A draw adds normal noise of the variance that the release noise and the sampling of n rows leave, to empty cells as well,
    and is then moved to tables whose margins agree. So every draw is a set of counts that some table could have, and what is
    not known about empty cells shows as rows in them. A group is DRAWS_AT_ONCE draws of some hundred cells.
    """
    shapes = [(domain.size(a), domain.size(b)) for a, b in pairs]
    firsts = np.concatenate([[0], np.cumsum([a * b for a, b in shapes])])
    total = float(n)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw_id", "clique_id", "cell"])
        y, z = frame[value].to_numpy(float).reshape(-1, firsts[-1]), frame["z"].to_numpy(float).reshape(-1, firsts[-1])
        if spread:
            centre = np.clip(y, 0, total)
            y = y + np.sqrt(sigma * sigma + centre * (1 - centre / max(total, 1.0))) * z * (1 if sigma else y > 0)
        out = agree([y[:, s:e].reshape(-1, *k) for s, e, k in zip(firsts, firsts[1:], shapes)], pairs, total)
        return frame[[*by, "draw_id", "clique_id", "cell"]].assign(n=np.concatenate([t.reshape(len(y), -1) for t in out], axis=1).ravel())

    many = cells.select(*by, "clique_id", "cell", F.col(value).cast("double").alias(value)).withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    many = many.withColumn("z", md5_normal(salt, *by, "draw_id", "clique_id", "cell"))
    kinds = {f.name: f.dataType.simpleString() for f in many.schema}
    shape = ", ".join([*[f"{c} {kinds[c]}" for c in (*by, "draw_id", "clique_id", "cell")], "n double"])
    return many.groupBy(*by, F.call_function("div", F.col("draw_id").cast("long"), F.lit(DRAWS_AT_ONCE)).alias("block")).applyInPandas(work, shape)
