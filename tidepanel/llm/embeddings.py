"""Near-duplicate vectors by cosine: tiles of rows compared in the order of principal directions.

Equal vectors are one class. Classes are rotated to principal directions (which changes no
cosine) and packed into tiles of at most TILE rows, each one file of the shared folder, written once.
A task takes a pair of blocks of tiles and reads their files; no tile is shuffled. It multiplies the
leading directions first. What the rest can add is at most the product of the two rest norms, which
is one more column of the same product, so a pair is left as soon as the sum so far and that
bound stay below the threshold. Pairs that come through are decided on the original vectors.

A task returns, for each class, the number of linked vectors and one edge to the smallest
member of its component within the task; a dense group never becomes a list of all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.components import components
from tidepanel.llm.vectors import by_width, keyed, unit
from tidepanel.session import fresh_path, written
from tidepanel.sources import blocks

THRESHOLD = 0.95
TILE = 2048
BLOCK_ROWS = 16_384  # rows of a block of tiles at most
BLOCK_BYTES = 32_000_000  # rotated and original vectors of a block at most, where it has more than one tile
BLOCKS = 24  # blocks to make of a smaller table, so that its pairs are enough tasks
TASKS = 2_000  # tasks of the comparison at most
STRIP = 256  # rows compared at a time, with as many columns as a tile has
STEPS = (24, 48)  # leading directions after which pairs are left
MARGIN = 1e-5  # rounding of the products of floats allowed for in the bounds
PAIRS = 20_000  # pairs gathered at a time
EDGES = 500_000  # pairs kept before they are folded into components


def _directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal directions of the unit vectors of each length, from sums of dims x dims products per task."""

    def sums(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, found in by_width(batch.column(0)):
                rows = unit(found)
                totals[dims] = totals.get(dims, 0) + rows.T @ rows
        for dims, total in totals.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(dims * dims, dims), "i": np.repeat(np.arange(dims), dims),
                                              "j": np.tile(np.arange(dims), dims), "x": total.ravel()})

    added = vectors.mapInArrow(sums, "d bigint, i bigint, j bigint, x double").groupBy("d", "i", "j").agg(F.sum("x"))
    moments: dict[int, np.ndarray] = {}
    for d, i, j, x in added.collect():  # dims * dims numbers per length
        moments.setdefault(d, np.zeros((d, d)))[i, j] = x
    out = {}
    for d, m in moments.items():
        values, directions = np.linalg.eigh((m + m.T) / 2)
        out[d] = directions[:, np.argsort(-values)]
    return out


def _tiles(classes: DataFrame, directions: dict[int, np.ndarray], tile: int, folder: str) -> DataFrame:
    """(dims, n, name): a file per tile with ids, class sizes, rotated unit vectors and original vectors.

    A tile is what a task meets in a row, so classes (node, n, vector) are not dealt again for it."""

    def pack(batches):
        held: dict[int, list] = {}

        def done(dims, ids, sizes, vectors):
            name = blocks.save(folder, ids=ids, sizes=sizes, vectors=vectors,
                               rotated=(unit(vectors.astype(np.float64)) @ directions[dims]).astype(np.float32))
            return pa.RecordBatch.from_pydict({"dims": [dims], "n": [len(ids)], "name": [name]})

        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            floats = batch.column(2).type.value_type == pa.float32()
            for dims, at, rows in by_width(batch.column(2)):
                more = [ids[at], sizes[at], rows.astype(np.float32) if floats else rows]
                if dims in held:
                    more = [np.concatenate(x) for x in zip(held.pop(dims), more)]
                full = len(more[0]) // tile * tile
                for start in range(0, full, tile):
                    yield done(dims, *(x[start:start + tile] for x in more))
                if len(more[0]) > full:
                    held[dims] = [x[full:] for x in more]
        for dims, rest in held.items():
            yield done(dims, *rest)

    return classes.select("node", "n", "vector").mapInArrow(pack, "dims bigint, n bigint, name string")


def _bounded(rows: np.ndarray, lead: int) -> np.ndarray:
    """Leading columns and the norm of the rest: products of such rows are bounds of the products of whole rows."""
    if lead == rows.shape[1]:
        return rows
    return np.hstack([rows[:, :lead], np.linalg.norm(rows[:, lead:].astype(np.float64), axis=1, keepdims=True).astype(np.float32)])


def _close(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Index pairs of rows with cosine >= threshold, some at a time. a, b: rotated unit rows (floats); x, y: original rows."""
    dims = a.shape[1]
    leads = [s for s in STEPS if s < dims] or [dims]
    short_a, short_b = ({s: _bounded(m, s) for s in leads} for m in (a, b))
    scaled_x = unit(x.astype(np.float64))
    scaled_y = scaled_x if y is x else unit(y.astype(np.float64))
    first_a, first_b = short_a[leads[0]], short_b[leads[0]]
    for start in range(0, len(a), STRIP):
        end = min(start + STRIP, len(a))
        for left in range(start if same else 0, len(b), TILE):
            bound = first_a[start:end] @ first_b[left:left + TILE].T
            at = np.flatnonzero(bound >= threshold - MARGIN)
            if not len(at):
                continue
            rows, columns = np.divmod(at, bound.shape[1])
            rows += start
            columns += left
            if same:
                later = rows < columns
                rows, columns = rows[later], columns[later]
            for lead in leads[1:]:  # bounds with more directions
                keep = [np.einsum("ij,ij->i", short_a[lead][rows[k:k + PAIRS]], short_b[lead][columns[k:k + PAIRS]]) >= threshold - MARGIN
                        for k in range(0, len(rows), PAIRS)]
                if keep:
                    kept = np.concatenate(keep)
                    rows, columns = rows[kept], columns[kept]
            exact = [np.einsum("ij,ij->i", scaled_x[rows[k:k + PAIRS]], scaled_y[columns[k:k + PAIRS]]) >= threshold
                     for k in range(0, len(rows), PAIRS)]  # the cosine itself
            if exact:
                kept = np.concatenate(exact)
                if kept.any():
                    yield rows[kept], columns[kept]


def _roots(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number in the component of each node; chains are halved with every round."""
    root = np.arange(nodes)
    while True:
        before = root.copy()
        low = np.minimum(before[left], before[right])
        for ends in (left, right):
            np.minimum.at(root, ends, low)
            np.minimum.at(root, before[ends], low)
        root = root[root]
        if (root == before).all():
            return root


def _links(spark, names: list[tuple[int, str]], folder: str, rows: int, threshold: float) -> DataFrame:
    """(node, links, low) of every class with links, per pair of blocks. names: rows and file of each tile of one length."""
    dealt = blocks.dealt(names, rows)

    def read(block: int) -> list[np.ndarray]:
        parts = [blocks.load(folder, name) for name in dealt[block]]
        return [np.concatenate([p[k] for p in parts]) for k in ("ids", "sizes", "rotated", "vectors")]

    def compare(batches):
        for batch in batches:
            for one, two in zip(*(batch.column(k).to_pylist() for k in range(2))):
                mine = read(one)
                other = mine if one == two else read(two)
                shift = 0 if one == two else len(mine[0])
                node, size = (mine[k] if one == two else np.concatenate([mine[k], other[k]]) for k in range(2))
                links, edges, kept = np.zeros(len(node)), [], 0
                for left, right in _close(mine[2], other[2], mine[3], other[3], threshold, one == two):
                    right = right + shift
                    links += np.bincount(left, size[right], len(node)) + np.bincount(right, size[left], len(node))
                    edges.append((left, right))
                    kept += len(left)
                    if kept > EDGES:
                        root = _roots(len(node), *map(np.concatenate, zip(*edges)))
                        hit = np.nonzero(root != np.arange(len(node)))[0]
                        edges, kept = [(hit, root[hit])], 0
                if not edges:
                    continue
                root = _roots(len(node), *map(np.concatenate, zip(*edges)))
                low = node.copy()
                np.minimum.at(low, root, node)
                hit = np.nonzero(links)[0]
                yield pa.RecordBatch.from_pydict({"node": node[hit], "links": links[hit].astype(np.int64), "low": low[root[hit]]})

    count = len(dealt)
    pairs = spark.range(count).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(count - 1).cast("bigint"))).alias("j"))
    tasks = min(TASKS, count * (count + 1) // 2)
    return written(pairs.repartition(tasks).mapInArrow(compare, "node bigint, links bigint, low bigint"), "links")


def near_duplicates(rows: DataFrame, *, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding).

    Vectors with cosine >= ``threshold`` in double precision are linked; equal vectors always.
    Vectors that are null, empty or zero, or hold a null or non-finite component, link with
    nothing, and vectors of different length not with each other. ``component_id`` is the
    smallest vec_id reachable. Rows that repeat a vec_id count as vectors of their own in
    ``n_links``. A row with a null vec_id takes no part: no links, a null component. Other columns
    are ignored.
    """
    every = written(keyed(rows.select("vec_id", "embedding")), "vectors")
    good = every.where("ok and vec_id is not null")
    groups = written(good.groupBy("k1", "k2").agg(F.min("vec_id").cast("bigint").alias("node"),
                                                  F.count(F.lit(1)).alias("n")), "groups")
    directions = _directions(good.select("vector"))
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").cast("bigint").alias("node"), F.count(F.lit(1)).alias("n"),
                                           F.any_value("vector").alias("vector"))
    spark, folder = rows.sparkSession, fresh_path(rows.sparkSession, "tiles")
    names: dict[int, list] = {}
    for dims, n, name in written(_tiles(classes, directions, tile, folder), "tile-names").collect():  # one row per tile
        names.setdefault(dims, []).append((n, name))
    found = None
    for dims, mine in sorted(names.items()):
        count = sum(n for n, _ in mine)
        most = max(tile, min(BLOCK_ROWS, BLOCK_BYTES // (16 * dims), -(-count // BLOCKS)))
        links = _links(spark, sorted(mine), folder, most, threshold)
        found = links if found is None else found.union(links)
    part = F.col("ok") & F.col("vec_id").isNotNull()
    plain = every.select("vec_id", F.when(part, F.col("k1")).alias("k1"), F.when(part, F.col("k2")).alias("k2"))
    named = plain.join(groups, ["k1", "k2"], "left")
    if found is None:
        named = named.withColumns({"links": F.lit(0), "root": F.lit(None).cast("bigint")})
    else:
        added = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
        named = named.join(added, "node", "left").join(roots, "node", "left")
    return (named.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("n_links"),
                         F.coalesce("root", "node", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
