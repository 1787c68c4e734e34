"""Cleaning a survey table: sentinels, recoding, column selection, filters, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions.keyed import md5_uniform
from tallyveil.functions.text import clean_name
from tallyveil.operators.numbering import number_rows


def sentinel_to_null(df: DataFrame, sentinel: str = "?", columns: Sequence[str] | None = None) -> DataFrame:
    """Replace a text that stands for "missing" by null."""
    return df.replace(sentinel, None, subset=list(columns) if columns else None)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without any null."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def recode(df: DataFrame, column: str, *maps: Mapping) -> DataFrame:
    """Apply value maps one after the other; values no map names stay."""
    expr = F.col(column)
    for m in maps:
        pairs = list(m.items())
        out = reduce(lambda acc, kv: acc.when(expr == F.lit(kv[0]), F.lit(kv[1])), pairs[1:],
                     F.when(expr == F.lit(pairs[0][0]), F.lit(pairs[0][1]))) if pairs else None
        expr = out.otherwise(expr) if out is not None else expr
    return df.withColumn(column, expr)


def collapse_labels(df: DataFrame, column: str, labels: Sequence[str], into: str) -> DataFrame:
    """Give several labels one common name."""
    return df.withColumn(column, F.when(F.col(column).isin(list(labels)), F.lit(into)).otherwise(F.col(column)))


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns in table order; names the table lacks are ignored."""
    wanted = set(columns)
    return df.select([c for c in df.columns if c in wanted])


def target_last(df: DataFrame, target: str) -> DataFrame:
    """Move the target column to the end."""
    if target not in df.columns:
        raise ValueError(f"no column {target!r}")
    return df.select([c for c in df.columns if c != target] + [target])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast by a column -> type table."""
    unknown = set(types) - set(df.columns)
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)}")
    return df.select([F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def all_numeric(df: DataFrame) -> DataFrame:
    """Every column as a number: integers stay, everything else becomes double."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return df.select([
        F.col(f.name) if isinstance(f.dataType, whole) else F.col(f.name).cast("double").alias(f.name)
        for f in df.schema
    ])


def all_categorical(df: DataFrame) -> DataFrame:
    """Every column as a label."""
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def positive_flag(column: str | Column) -> Column:
    """1 when the value is above zero, else 0."""
    col = F.col(column) if isinstance(column, str) else column
    return (col > 0).cast("int")


def overwrite_column(df: DataFrame, target: str, source: str) -> DataFrame:
    """Replace one column's values by another's."""
    return df.withColumn(target, F.col(source))


def all_true(flags: Sequence[Column]) -> Column:
    """Conjunction of filters."""
    return reduce(lambda a, b: a & b, flags)


def any_true(flags: Sequence[Column]) -> Column:
    """Alternative of filters."""
    return reduce(lambda a, b: a | b, flags)


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round chosen columns, ties to even as array libraries do."""
    def rounded(c: str) -> Column:
        scale = F.lit(10.0 ** digits[c])
        return (F.rint(F.col(c) * scale) / scale).alias(c)

    return df.select([rounded(c) if c in digits else F.col(c) for c in df.columns])


def split_by_position(df: DataFrame, key: str, n_train: int) -> DataFrame:
    """First `n_train` rows in key order are `train`, the rest `test` (column `part`)."""
    numbered = number_rows(df, key, "__pos")
    return numbered.withColumn("part", F.when(F.col("__pos") <= n_train, "train").otherwise("test")).drop("__pos")


def split_by_fraction(df: DataFrame, key: str, train_fraction: float, salt: str = "split") -> DataFrame:
    """Repeatable random split by a hash of the row key (column `part`)."""
    return df.withColumn("part", F.when(md5_uniform(salt, key) < train_fraction, "train").otherwise("test"))


def sanitise_names(df: DataFrame) -> DataFrame:
    """Column names reduced to letters, digits and underscores; a collision raises."""
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after cleaning: {names}")
    return df.toDF(*names)
