"""Vectors as classes of equal rows, and groups of them packed into one binary row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector with a direction: not null or empty, all components finite, not all zero."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, vector (floats stay floats, all else doubles), ok, and two hashes that name the class of equal vectors."""
    wide = F.col("embedding").cast("array<double>")
    floats = dict(rows.dtypes)["embedding"] == "array<float>"
    return rows.select("vec_id", (F.col("embedding") if floats else wide).alias("vector"), usable(F.col("embedding")).alias("ok"),
                       F.xxhash64(wide).alias("k1"), F.xxhash64(F.lit(1), F.reverse(wide)).alias("k2"))


def matrix(column) -> np.ndarray:
    """Arrow list column without nulls -> rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_width(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of the rows, rows of doubles) for each length of vector in an Arrow list column without nulls."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        at = np.nonzero(lengths == dims)[0]
        yield dims, at, matrix(column if len(at) == len(column) else column.take(at))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny and huge vectors keep their direction."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
