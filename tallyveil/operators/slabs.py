"""Long vectors of sums, filled inside tasks and added up slab by slab.

A task that has reduced its rows to one vector hands it on as rows of WIDTH numbers: (keys..., slab, v0, v1, ...). Built-in sums
add those, with partial sums before the shuffle. What moves depends on the length of the vector and the number of tasks, not
on the rows, and nobody holds the vectors of all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 32
VALUES = [f"v{i}" for i in range(WIDTH)]


def schema(kind: str) -> str:
    """DDL of the slab columns; `kind` is long or double."""
    return ", ".join(["slab long", *[f"{v} {kind}" for v in VALUES]])


def pack(vector: np.ndarray) -> dict[str, pa.Array]:
    """Slab columns of a vector, without slabs of zeros."""
    table = _folded(vector[None])[0]
    at = np.flatnonzero(table.any(axis=1))
    return _columns(at, table[at])


def pack_many(vectors: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Slab columns of several vectors, one per row, and the row each slab is of; of slabs of zeros only a vector's first stays."""
    table = _folded(vectors)
    kept = table.any(axis=2)
    kept[:, 0] = True
    which, at = np.nonzero(kept)
    return which, _columns(at, table[which, at])


def _folded(vectors: np.ndarray) -> np.ndarray:
    n, length = vectors.shape
    table = np.zeros((n, -(-length // WIDTH) * WIDTH), vectors.dtype)
    table[:, :length] = vectors
    return table.reshape(n, -1, WIDTH)


def _columns(at: np.ndarray, values: np.ndarray) -> dict[str, pa.Array]:
    return {"slab": pa.array(at, pa.int64()), **{v: pa.array(np.ascontiguousarray(values[:, i])) for i, v in enumerate(VALUES)}}


def add_up(slabs: DataFrame, keys: Sequence[str] = (), *more) -> DataFrame:
    """Sums per key and slab; `more` are further aggregates."""
    return slabs.groupBy(*keys, "slab").agg(*[F.sum(v).alias(v) for v in VALUES], *more)


def spread(slabs: DataFrame, keys: Sequence[str], place: str, value: str) -> DataFrame:
    """One row per number that is not 0: (keys..., place in the vector, number)."""
    numbers = slabs.select(*keys, "slab", F.posexplode(F.array(*VALUES)).alias("__at", value)).filter(F.col(value) != 0)
    return numbers.select(*keys, (F.col("slab") * WIDTH + F.col("__at")).alias(place), value)


def unpack_many(which: np.ndarray, slab: np.ndarray, values: np.ndarray, n: int, length: int) -> np.ndarray:
    """The n vectors, one per row, from their slabs."""
    table = np.zeros((n, -(-length // WIDTH), WIDTH), values.dtype)
    table[which, slab] = values
    return table.reshape(n, -1)[:, :length]
