"""Exact clustering around centroids over blocks of a space-filling curve.

Vectors are made whole numbers, ordered along a Hilbert curve through their most varied
components and packed into blocks with the box (smallest and largest value of each component) and the sum of their
vectors. In a round each block first asks its box: over a box the difference of the squared distances to
two centroids is a linear function, so its largest value is known exactly, and a centroid that another one
beats everywhere in the box is no candidate. With one candidate left the stored sum of the block is all
that is needed; else the vectors are compared with the candidates, exactly, in whole numbers.

Rows that take no part: null vectors, those of another length, and those with a null or non-finite component.
Components beyond 2**17 in size count as that bound, so that every squared distance fits a long; sums
of distances stop at the largest long. Repeated rows and null ids are vectors like any other. An empty table has an
empty result; with fewer vectors than centroids there are as many centroids as vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import written

DIMENSIONS = 64
SCALE = 1024
BOUND = 1 << 27  # of a component after scaling
BLOCK = 256  # vectors of a block
CURVE_DIMENSIONS, CURVE_BITS = 8, 7
EXACT = 1 << 22  # below it products of doubles add up without rounding
LARGEST = (1 << 63) - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below 2**bits (Skilling, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


# ---- whole numbers ----------------------------------------------------------
def scaled(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and vector (longs, floor of scale times each component) of the rows that take part."""
    wide = F.col("embedding").cast("array<double>")
    fits = (F.size(wide) == dimensions) & ~F.exists(
        wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    low, high = F.lit(float(-BOUND)), F.lit(float(BOUND))
    return rows.where(F.coalesce(fits, F.lit(False))).select(
        "vec_id", F.transform(wide, lambda x: F.floor(F.least(F.greatest(x * scale, low), high)).cast("int")).alias("vector"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _spread(vectors: DataFrame, dimensions: int) -> list[tuple[int, int, int]]:
    """(component, smallest, largest) of the most varied components; one row reaches the driver."""
    cells = [f for i in range(dimensions) for f in (
        F.min(F.col("vector")[i]), F.max(F.col("vector")[i]), F.coalesce(F.var_pop(F.col("vector")[i]), F.lit(0.0)))]
    row = vectors.agg(*cells).first()
    if row[0] is None:
        return []
    order = sorted(range(dimensions), key=lambda i: (-row[3 * i + 2], i))[:CURVE_DIMENSIONS]
    return [(i, row[3 * i], row[3 * i + 1]) for i in order]


def _packed(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Blocks along the curve: ids, n, vectors, low, high, total. Equal places are split by a hash of the id."""
    spread = _spread(vectors, dimensions)
    ids = vectors.schema["vec_id"].dataType

    def placed(batches):
        for batch in batches:
            rows = _matrix(batch.column(1))
            cells = np.zeros((len(rows), CURVE_DIMENSIONS), np.int64)
            for j, (i, low, high) in enumerate(spread):
                cells[:, j] = (rows[:, i] - low) * ((1 << CURVE_BITS) - 1) // max(high - low, 1)
            place = pa.array(hilbert(cells, CURVE_BITS))
            flat = pa.array([row.tobytes() for row in rows.astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), place, flat], names=["vec_id", "place", "cells"])

    out = T.StructType([T.StructField("vec_id", ids), T.StructField("place", T.LongType()),
                        T.StructField("cells", T.BinaryType())])
    salt = F.xxhash64("vec_id", "cells")
    ordered = (vectors.mapInArrow(placed, out).withColumn("salt", salt)
               .repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").drop("salt", "place"))
    block = T.StructType([
        T.StructField("ids", T.ArrayType(ids)), T.StructField("n", T.LongType()), T.StructField("cells", T.BinaryType()),
        T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("total", T.BinaryType())])

    def packed(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(block)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(part.num_rows, -1)
                wide = rows.astype(np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "ids": part.column(0).to_pylist(), "n": len(rows), "cells": rows.tobytes(),
                    "low": wide.min(axis=0).tobytes(), "high": wide.max(axis=0).tobytes(),
                    "total": wide.sum(axis=0).tobytes()}], schema)

    return written(ordered.mapInArrow(packed, block), "blocks")


# ---- one block against the centroids ----------------------------------------
def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> list[int]:
    """Centroids that are the nearest one of some point of the box, ties to the smaller number."""
    square = np.einsum("ij,ij->i", centroids, centroids)
    left = list(range(len(centroids)))
    for k in range(len(centroids)):
        # |x - other|^2 - |x - k|^2 = 2 x (k - other) + |other|^2 - |k|^2, at its largest over the box
        step = centroids[k] - centroids
        most = 2 * (np.where(step > 0, high, low) * step).sum(axis=1) + square - square[k]
        most[k] = 1
        if (most < 0).any() or (most[:k] <= 0).any():
            left.remove(k)
    return left


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row, the smaller of equals."""
    square = np.einsum("ij,ij->i", centroids, centroids)
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        products = rows.astype(np.float64) @ centroids.T.astype(np.float64)
        return (square - 2 * products).argmin(axis=1)
    return (square - 2 * np.stack([(rows * c).sum(axis=1) for c in centroids], axis=1)).argmin(axis=1)


def distances(rows: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    step = rows - centroids[cluster]
    return np.einsum("ij,ij->i", step, step)


def _clusters(block: dict, centroids: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | int]:
    """(rows, cluster of each), or (None, the cluster of all of them)."""
    left = candidates(np.frombuffer(block["low"], np.int64), np.frombuffer(block["high"], np.int64), centroids)
    if len(left) == 1:
        return None, left[0]
    rows = _rows(block)
    return rows, np.array(left)[nearest(rows, centroids[left])]


def _rows(block: dict) -> np.ndarray:
    return np.frombuffer(block["cells"], np.int32).reshape(block["n"], -1).astype(np.int64)


def _blocks(batches):
    """Blocks one by one; an Arrow batch is not made into Python objects as a whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# ---- rounds -----------------------------------------------------------------
def _totals(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, their sum)}: a row per task and cluster is shuffled, a row per cluster reaches the driver."""
    k, d = centroids.shape

    def part(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, d), object)
        for block in _blocks(batches):
            rows, cluster = _clusters(block, centroids)
            if rows is None:
                count[cluster] += block["n"]
                total[cluster] += np.frombuffer(block["total"], np.int64).astype(object)
                continue
            for c in np.unique(cluster):
                mine = cluster == c
                count[c] += mine.sum()
                total[c] += rows[mine].sum(axis=0).astype(object)
        full = [c for c in range(k) if count[c]]
        columns = [pa.array(full, pa.int32()), pa.array(count[full])]
        columns += [pa.array([str(total[c, i]) for c in full], pa.string()) for i in range(d)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"s{i}" for i in range(d))])

    sums = ", ".join(f"s{i} string" for i in range(d))
    found = blocks.select("n", "cells", "low", "high", "total").mapInArrow(part, f"cluster int, n long, {sums}")
    found = found.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")) for i in range(d)])
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in found.collect()}  # at most k rows


def cluster(rows: DataFrame, *, k: int = 8, rounds: int = 10, seed: Column | None = None,
            dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part.

    The first centroids are the ``k`` vectors with the smallest ``seed``, in its order (by
    default the sha256 of "3:" and the id; equal seeds by the vector). Each round replaces a centroid that has vectors by
    the floor of their mean; rounds end early when nothing changes. Only centroids reach the driver.
    """
    seed = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256) if seed is None else seed
    vectors = scaled(rows, dimensions, scale)
    # k rows
    first = vectors.select(seed.alias("seed"), "vector").orderBy("seed", "vector").limit(k).collect()
    out = T.StructType([vectors.schema["vec_id"], *(T.StructField(n, t) for n, t in (
        ("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()),
        ("inertia", T.LongType()), ("centroid_sha256", T.StringType())))])
    if not first:
        return rows.sparkSession.createDataFrame([], out)
    centroids = np.array([list(r["vector"]) for r in sorted(first, key=lambda r: (r["seed"], list(r["vector"])))], np.int64)
    blocks = _packed(vectors, dimensions)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in _totals(blocks, centroids).items():
            moved[c] = [x // n for x in total]
        if (moved == centroids).all():
            break
        centroids = moved
    inertia = _inertia(blocks, centroids)
    return _assigned(blocks, centroids, inertia, out)


def _inertia(blocks: DataFrame, centroids: np.ndarray) -> dict[int, int]:
    """{cluster: distances summed up}; at most k rows reach the driver."""
    def part(batches):
        total: dict[int, int] = {}
        for block in _blocks(batches):
            rows, own = _clusters(block, centroids)
            rows = _rows(block) if rows is None else rows
            own = np.broadcast_to(own, len(rows))
            far = distances(rows, centroids, own)
            for c in np.unique(own).tolist():
                total[c] = total.get(c, 0) + sum(far[own == c].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([str(x) for x in total.values()], pa.string())],
            names=["cluster", "s"])

    found = blocks.select("n", "cells", "low", "high").mapInArrow(part, "cluster int, s string")
    return {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect()}


def _assigned(blocks: DataFrame, centroids: np.ndarray, inertia: dict[int, int], out: T.StructType) -> DataFrame:
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = min(sum(inertia.values()), LARGEST)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for block in _blocks(batches):
            rows, own = _clusters(block, centroids)
            rows = _rows(block) if rows is None else rows
            own = np.broadcast_to(own, len(rows))
            far = distances(rows, centroids, own)
            columns = [block["ids"], own.tolist(), far.tolist(), [min(inertia[c], LARGEST) for c in own.tolist()],
                       [whole] * len(rows), [digest[c] for c in own.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    return blocks.select("ids", "n", "cells", "low", "high").mapInArrow(run, out)
