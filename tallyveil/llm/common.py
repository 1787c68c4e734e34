"""Small helpers that several operators share: written intermediate tables and prefixed working columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.session import scratch_path

MOST_PLACES = 1 << 27  # bits of the bitmap that `sifted` broadcasts (16 MB)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that `saved` wrote, once nothing reads them any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """All rows whose key is in `wanted` and few others, so that a join that follows moves few rows.

    A broadcast bitmap tells which hashes the wanted keys have. It has 8 to 16 bits a key, or MOST_PLACES, where more of the other rows stay.
    """
    places = min(MOST_PLACES, 1 << max(15, (8 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(places)) + 1  # counted from 1, as bitmaps are
    maps = wanted.select(place.alias("__place")).groupBy(F.bitmap_bucket_number("__place").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    placed = rows.select("*", F.bitmap_bucket_number(place).alias("__at"), F.bitmap_bit_position(place).alias("__bit"))
    byte = "int(conv(hex(substring(__bits, int(__bit div 8) + 1, 1)), 16, 10))"
    return placed.join(F.broadcast(maps), F.col("__at") == F.col("__part")).where(f"shiftright({byte}, int(__bit % 8)) & 1 = 1").select(*rows.columns)


def carrying(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return the columns of their documents: the caller's columns with names like the operator's own
    working columns (two leading underscores) have other names inside, so neither overwrites the other."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        inside = list(docs.columns)
        for i, name in enumerate(inside):
            while inside[i].startswith("__") or inside.count(inside[i]) > 1:
                inside[i] = f"carried_{inside[i]}"
        if inside == docs.columns:
            return operator(docs, *args, **options)
        return operator(docs.toDF(*inside), *args, **options).toDF(*docs.columns)

    return run


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
