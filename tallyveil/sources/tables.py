"""Reading and writing plain tables: headers, foreign separators, globs, appended logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SINK_MODES = {"replace": "overwrite", "append": "append"}


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A table with a header (csv) or an embedded schema (parquet, orc, json)."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv needs a schema; inferring one would scan the data twice")
        reader = reader.option("header", True)
    return reader.load(path)


def read_headerless(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma + blank separated text without a header, names and types from the schema."""
    return (
        spark.read.schema(schema)
        .option("sep", ",")
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def read_categories(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A csv whose every column is read as a label, whatever it looks like."""
    return read_table(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns]), "csv")


def write_table(df: DataFrame, path: str, mode: str = "replace", fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """Write with mode `replace` or `append`; any other mode is refused."""
    if mode not in SINK_MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {sorted(SINK_MODES)}")
    writer = df.write.mode(SINK_MODES[mode]).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def combine(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate result tables by column name; columns a table lacks become null."""
    if not frames:
        raise ValueError("nothing to combine")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def with_path_parts(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Take metadata from the file path each row came from; `pattern` has one group per name."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def drop_repeated_headers(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Remove header lines repeated inside an appended text table, then cast by column.

    A value that does not parse becomes null.
    """
    first = df.columns[0]
    rows = df.filter(F.col(first).isNull() | (F.col(first) != F.lit(first)))
    return rows.select([F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])
