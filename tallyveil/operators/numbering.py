"""Row numbers and running sums over a whole table without one global window task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.sqltext import array, ident

MAX_SLOTS = 4096
SLOT_ROWS = 1_000_000  # rows one task numbers, until there are MAX_SLOTS ranges
QUANTILE_ACCURACY = 50_000

def range_slots(df: DataFrame, key: str, slots: int | None = None, out: str = "__slot") -> DataFrame:
    """Add the number of the key range a row is in; ranges hold about equally many rows.

    One pass finds the row count and approximate quantiles; the number of ranges grows with the rows. Split points
    only balance work, never change results. The key is unique, so no range can be dominated by one value.
    """
    probs = [i / MAX_SLOTS for i in range(1, MAX_SLOTS)]
    quantiles = f"percentile_approx(double({ident(key)}), {array(probs)}, {QUANTILE_ACCURACY})"
    n, found = df.select(F.count(key), F.expr(quantiles)).first()
    slots = slots or max(2, min(MAX_SLOTS, n // SLOT_ROWS))
    step = max(1, MAX_SLOTS // slots)
    splits = sorted(set((found or [])[step - 1::step]))
    if not splits:
        return df.withColumn(out, F.lit(0))
    place = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="__key", outputCol="__at", handleInvalid="keep")
    placed = place.transform(df.withColumn("__key", F.col(key).cast("double")))
    return placed.withColumn(out, F.col("__at").cast("int")).drop("__key", "__at")


def number_rows(df: DataFrame, key: str, out: str, slots: int | None = None, start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of a unique numeric key.

    Each key range is numbered by its own task; ranges are lined up with their row counts
    (one small row per range on the driver).
    """
    ranged = range_slots(df, key, slots)
    counts = {r[0]: r[1] for r in ranged.groupBy("__slot").count().collect()}
    offsets, total = [], start - 1
    for s in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(s, 0)
    base = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("__slot") + 1) if offsets else F.lit(0)
    within = F.row_number().over(W.partitionBy("__slot").orderBy(key))
    return ranged.withColumn(out, within + base).drop("__slot")


def running_sum(df: DataFrame, key: str, value: str, out: str, slots: int | None = None) -> DataFrame:
    """Inclusive running sum of a column in key order, same scheme as `number_rows`."""
    ranged = range_slots(df, key, slots)
    sums = {r[0]: r[1] for r in ranged.groupBy("__slot").agg(F.sum(value)).collect()}
    offsets, total = [], 0.0
    for s in range(max(sums, default=-1) + 1):
        offsets.append(float(total))
        total += sums.get(s) or 0.0
    base = F.element_at(F.array(*[F.lit(o) for o in offsets]), F.col("__slot") + 1) if offsets else F.lit(0.0)
    window = W.partitionBy("__slot").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.withColumn(out, F.sum(value).over(window) + base).drop("__slot")
