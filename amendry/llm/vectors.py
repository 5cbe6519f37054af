"""Vectors as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers of this size and less have squared distances over 64 components that fit a long.
LARGEST = 1 << 27


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def integers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components of usable vectors, a row for each."""
    found = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, dims)
    with np.errstate(over="ignore"):
        scaled = np.floor(found * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} in size have distances that don't fit a long")
    return scaled.astype(np.int64)


def attach_totals(rows: DataFrame, totals: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """`rows` with the columns of `totals`, one row a key, nulls equal. Totals of up to `most` keys, counted first, are
    sent to every task; more are joined by a shuffle, whose crowded keys adaptive execution splits."""
    other = totals.withColumnRenamed(key, f"{key}_of_total")
    other = F.broadcast(other) if totals.limit(most + 1).count() <= most else other
    return rows.join(other, rows[key].eqNullSafe(other[f"{key}_of_total"])).drop(f"{key}_of_total")
