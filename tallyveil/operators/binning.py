"""Discretising numeric columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.sqltext import ident, literal, search
from tallyveil.operators.cleaning import all_categorical, cast_columns, collapse_labels, keep_columns, overwrite_column, target_last

# Share of the range the first edge is lowered by, label digits, where fixed-width buckets end.
EDGE_SHARE = 0.001
LABEL_DIGITS = 3
BUCKET_END = 100


@dataclass(frozen=True)
class Edges:
    """The k+1 edges of k right-closed bins, their labels, in bin order."""

    values: tuple[float, ...]
    labels: tuple[str, ...]


def _round_edge(x: float, digits: int) -> float:
    """Keep `digits` decimals of a number with a whole part, else `digits` leading ones."""
    if not math.isfinite(x) or x == 0:
        return x
    frac, whole = math.modf(x)
    places = -int(math.floor(math.log10(abs(frac)))) - 1 + digits if whole == 0 else digits
    return round(x, places)


def make_edges(low: float, high: float, bins: int) -> Edges:
    """Equal-width edges between an observed minimum and maximum."""
    low, high = float(low), float(high)
    if low == high:
        low, high = low - (EDGE_SHARE * abs(low) if low else EDGE_SHARE), high + (EDGE_SHARE * abs(high) if high else EDGE_SHARE)
        width, lowered = (high - low) / bins, 0.0
    else:
        width, lowered = (high - low) / bins, (high - low) * EDGE_SHARE
    values = [low + i * width for i in range(bins)] + [high]
    values[0] -= lowered
    for digits in range(LABEL_DIGITS, 20):
        shown = [_round_edge(v, digits) for v in values]
        if len(set(shown)) == len(shown):
            break
    labels = tuple(f"({a}, {b}]" for a, b in zip(shown, shown[1:]))
    return Edges(tuple(values), labels)


def fit_edges(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, Edges]:
    """Edges of several columns from one pass (min and max of each)."""
    row = df.agg(*[f(c).alias(f"{c}:{f.__name__}") for c in columns for f in (F.min, F.max)]).first()
    return {c: make_edges(row[f"{c}:min"], row[f"{c}:max"], bins) for c in columns}


def _bin(column: str, edges: Edges, values: Sequence) -> Column:
    name = ident(column)
    inside = search([literal(v) for v in edges.values[1:-1]], lambda i: literal(values[i]), f"double({name}) <=")
    low, high = literal(edges.values[0]), literal(edges.values[-1])
    return F.expr(f"CASE WHEN double({name}) > {low} AND double({name}) <= {high} THEN {inside} END")


def bin_code(column: str, edges: Edges) -> Column:
    """Bin number from 0; right-closed; null outside the edges."""
    return _bin(column, edges, list(range(len(edges.labels))))


def bin_label(column: str, edges: Edges) -> Column:
    """Bin label `(a, b]`; null outside the edges."""
    return _bin(column, edges, edges.labels)


def width_bucket_label(column: str | Column, width: int) -> Column:
    """Left-closed bucket label `i - i+width` on [0, 100); null elsewhere."""
    col = F.col(column) if isinstance(column, str) else column
    edges, starts = range(0, BUCKET_END + 5, width), range(0, BUCKET_END, width)
    if len(edges) != len(starts) + 1:
        raise ValueError(f"buckets of {width} do not end near {BUCKET_END}")
    low = (F.floor(col / width) * width).cast("int")
    return F.when((col >= 0) & (col < edges[-1]), F.concat_ws(" - ", low.cast("string"), (low + width).cast("string")))


def apply_edges(df: DataFrame, edges: Mapping[str, Edges]) -> DataFrame:
    """Replace numeric columns by the labels of edges fitted elsewhere (train -> test)."""
    return df.select([bin_label(c, edges[c]).alias(c) if c in edges else F.col(c) for c in df.columns])


def apply_per_table(df: DataFrame, table_key: str, column: str, bins: int, out: str) -> DataFrame:
    """Bin numbers with edges of each table's own minimum and maximum.

    One small row of edges per table; the edge table is joined back (broadcast when AQE sees it is small).
    """
    stats = df.groupBy(table_key).agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    code = sum([(F.col(column) > F.col("__lo") + F.lit(float(i)) * width).cast("int") for i in range(1, bins)], F.lit(0))
    return df.join(stats, table_key).withColumn(out, code).drop("__lo", "__hi")


@dataclass(frozen=True)
class Preset:
    """How one named survey table is prepared."""

    columns: tuple[str, ...]
    target: str
    binned: tuple[str, ...] = ()
    n_buckets: int | None = None
    bucket_size: int | None = None
    collapse: Mapping[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    casts: Mapping[str, str] = field(default_factory=dict)
    overwrite: Mapping[str, str] = field(default_factory=dict)


# The census columns, the married labels, and each preset's columns and binning.
_MARRIED = {"marital-status": (("Married-civ-spouse", "Married-spouse-absent", "Married-AF-spouse"), "Married")}
_BINNED = ("age", "hours-per-week")
_ALL = ("age", "workclass", "education-num", "marital-status", "occupation", "relationship", "race", "sex",
        "capital-gain", "capital-loss", "hours-per-week", "native-country", "had-capital-gains",
        "had-capital-losses", "compensation")
_DROPPED = ("had-capital-gains", "had-capital-losses", "capital-gain", "capital-loss")
_NINE = ("age", "sex", "education-num", "hours-per-week", "workclass", "marital-status", "had-capital-gains",
         "had-capital-losses", "compensation")
_COUNTS = {"age": "int", "capital-gain": "int", "capital-loss": "int", "hours-per-week": "int"}
CENSUS_PRESETS = {
    "adult_raw": Preset(_ALL, "compensation", casts=_COUNTS),
    "adult_small": Preset(("education-num", "marital-status", "sex", "age", "hours-per-week", "compensation"),
                          "compensation", _BINNED, n_buckets=5, collapse=_MARRIED),
    "adult_large": Preset(_NINE, "compensation", _BINNED, n_buckets=5, collapse=_MARRIED),
    "adult_no_discretization": Preset(_NINE, "compensation",
                                      casts={**_COUNTS, "had-capital-gains": "int", "had-capital-losses": "int"},
                                      overwrite={"had-capital-gains": "capital-gain",
                                                 "had-capital-losses": "capital-loss"}),
    "adult_low_discretization": Preset(_NINE, "compensation", _BINNED, n_buckets=5, collapse=_MARRIED),
    "adult_high_discretization": Preset(_NINE, "compensation", _BINNED, n_buckets=2, collapse=_MARRIED),
    "adult_independence_pruning": Preset(("education-num", "sex", "age", "hours-per-week", "compensation"),
                                         "compensation", _BINNED, n_buckets=2, collapse=_MARRIED),
    "adult_default": Preset(tuple(c for c in _ALL if c not in _DROPPED), "compensation", _BINNED, bucket_size=10,
                            collapse=_MARRIED),
}


def prepare(df: DataFrame, preset: Preset, edges: Mapping[str, Edges] | None = None) -> DataFrame:
    """Clean, collapse, bin and order a table as a preset says.

    `edges` fitted on the training table keep train and test labels equal; without them the
    table is cut by its own minimum and maximum.
    """
    if preset.binned and preset.n_buckets is None and preset.bucket_size is None:
        raise ValueError("a preset with binned columns needs n_buckets or bucket_size")
    out = df
    for target, source in preset.overwrite.items():
        out = overwrite_column(out, target, source)
    out = keep_columns(out, preset.columns)
    for column, (labels, into) in preset.collapse.items():
        if column in out.columns:
            out = collapse_labels(out, column, labels, into)
    if preset.binned:
        if preset.bucket_size is not None:
            out = out.select([width_bucket_label(c, preset.bucket_size).alias(c) if c in preset.binned else F.col(c)
                              for c in out.columns])
        else:
            out = apply_edges(out, edges or fit_edges(out, [c for c in preset.binned if c in out.columns], preset.n_buckets))
    if preset.casts:
        out = cast_columns(out, {c: t for c, t in preset.casts.items() if c in out.columns})
        rest = {c: "string" for c in out.columns if c not in preset.casts}
        return target_last(cast_columns(out, rest), preset.target)
    return target_last(all_categorical(out), preset.target)
