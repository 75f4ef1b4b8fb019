"""Nearest neighbours by one navigable small-world graph per shard, shard results merged.

Classes of equal vectors are dealt to shards of about SHARD vectors by a hash. Each shard holds
a hierarchical graph as flat arrays: for every level the neighbour numbers of every node of that
level, padded with -1. Nodes are linked in an order: a node takes its neighbours among the nodes
before it, chosen so that none is closer to another chosen one than to the node, and is linked
back; early nodes thereby keep far links. A level is filled in strips with matrix products, as
a shard is small.

Shards and blocks of queries are files of the shared folder, written once. A task reads a block of
queries and one shard of a range after the other, and returns the best classes of the range; neither
shards nor queries are shuffled or broadcast to meet. The best classes of all ranges are ranked by the
cosine of the original vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.vectors import keyed, matrix, unit
from tidepanel.session import fresh_path, written
from tidepanel.sources import blocks

SHARD = 4096
DEGREE = 16  # links a node takes; twice as many are kept on the lowest level
POOL = 64  # candidates a node chooses its links from
WIDTH = 128  # open nodes of a search
BLOCK = 256  # queries searched together
RANGE = 64  # shards a task searches at most for a block of queries
UNITS = 64  # blocks x ranges to make of a smaller table
TASKS = 2_000  # tasks of building and of searching at most
STRIP = 256


def levels(count: int) -> np.ndarray:
    """Highest level of each node, drawn with a fixed seed; the first node gets the top."""
    drawn = np.random.default_rng(count).random(count)
    level = np.floor(-np.log1p(-drawn) / np.log(DEGREE)).astype(np.int64)
    if count:
        level[0] = level.max()
    return level


def _chosen(similar: np.ndarray, pool: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none), those not closer to one chosen before; -1 padded."""
    width = pool.shape[1]
    near = rows[np.maximum(pool, 0)]
    among = np.einsum("bid,bjd->bij", near, near, optimize=True)
    taken = np.zeros(pool.shape, bool)
    count = np.zeros(len(pool), np.int64)
    for r in range(width):
        covered = (taken[:, :r] & (among[:, r, :r] > similar[:, r, None])).any(axis=1)
        taken[:, r] = (pool[:, r] >= 0) & ~covered & (count < most)
        count += taken[:, r]
    order = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(taken, order, 1), np.take_along_axis(pool, order, 1), -1)


def _linked(rows: np.ndarray, most: int) -> np.ndarray:
    """Neighbours of every node of a level: (nodes, most), -1 padded."""
    count = len(rows)
    out: list[list[int]] = [[] for _ in range(count)]
    for start in range(0, count, STRIP):
        end = min(start + STRIP, count)
        similar = rows[start:end] @ rows[:end].T
        similar[np.arange(end)[None, :] >= np.arange(start, end)[:, None]] = -np.inf  # earlier nodes only
        width = min(POOL, end)
        best = np.argpartition(-similar, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(similar, best, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        best, value = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
        best = np.where(np.isneginf(value), -1, best)
        for i, picked in zip(range(start, end), _chosen(value, best, rows, min(DEGREE, most)).tolist()):
            for j in picked:
                if j >= 0:
                    out[i].append(j)
                    out[j].append(i)
    links = np.full((count, most), -1, np.int32)
    for i, near in enumerate(out):
        if len(near) > most:
            pool = np.array(near)
            value = rows[pool] @ rows[i]
            order = np.argsort(-value, kind="stable")
            kept = _chosen(value[order][None, :], pool[order][None, :], rows, most)[0]
            near = kept[kept >= 0].tolist()
            # room that is left goes to the nearest of the others
            near += [j for j in pool[order].tolist() if j not in set(near)][:most - len(near)]
        links[i, :len(near)] = near
    return links


class Graph:
    """Graph of one shard over unit vectors, with flat neighbour arrays per level."""

    def __init__(self, rows: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows
        self.parts = []
        for members, links in parts:  # lowest level first
            place = np.full(len(rows), -1, np.int32)
            place[members] = np.arange(len(members))
            self.parts.append((place, links))

    @staticmethod
    def built(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        level = levels(len(rows))
        parts = []
        for at in range(int(level.max()) + 1 if len(rows) else 0):
            members = np.nonzero(level >= at)[0].astype(np.int32)
            links = _linked(rows[members], DEGREE * (2 if at == 0 else 1))
            parts.append((members, np.where(links >= 0, members[np.maximum(links, 0)], -1).astype(np.int32)))
        return parts

    def search(self, query: np.ndarray, width: int = WIDTH) -> list[tuple[float, int]]:
        """(similarity, node) of the nodes found, best first."""
        if not len(self.rows):
            return []
        best = (float(self.rows[0] @ query), 0)
        for place, links in reversed(self.parts[1:]):
            best = self._walk(query, [best], place, links, 1)[0]
        return self._walk(query, [best], *self.parts[0], width)

    def _walk(self, query, start, place, links, width):
        seen = np.zeros(len(self.rows), bool)
        seen[[n for _, n in start]] = True
        todo = [(-s, n) for s, n in start]
        held = list(start)
        heapq.heapify(todo)
        heapq.heapify(held)
        while todo:
            similar, node = heapq.heappop(todo)
            if len(held) >= width and -similar < held[0][0]:
                break
            near = links[place[node]]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for s, n in zip((self.rows[near] @ query).tolist(), near.tolist()):
                if len(held) < width:
                    heapq.heappush(held, (s, n))
                    heapq.heappush(todo, (-s, n))
                elif s > held[0][0]:
                    heapq.heapreplace(held, (s, n))
                    heapq.heappush(todo, (-s, n))
        return sorted(held, reverse=True)


def build(classes: DataFrame, shards: int, folder: str) -> DataFrame:
    """(shard, n, name): a file per shard with class numbers, vectors and, level by level, members and neighbours."""

    def packed(shard, ids, least, vectors):
        levelled = {}
        for at, (members, links) in enumerate(Graph.built(unit(vectors.astype(np.float64)))):
            levelled |= {f"members{at}": members, f"links{at}": links}
        name = blocks.save(folder, ids=ids, least=least, vectors=vectors, **levelled)
        return pa.RecordBatch.from_pydict({"shard": [shard], "n": [len(ids)], "name": [name]})

    def run(batches):
        shard, ids, least, vectors = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            of, node, small, data = *(batch.column(i).to_numpy() for i in range(3)), _rows(batch.column(3))
            borders = [0, *(np.nonzero(np.diff(of))[0] + 1), len(of)]
            for a, b in zip(borders[:-1], borders[1:]):
                if ids and of[a] != shard:
                    yield packed(shard, np.concatenate(ids), np.concatenate(least), np.concatenate(vectors))
                    ids, least, vectors = [], [], []
                shard = int(of[a])
                ids.append(node[a:b])
                least.append(small[a:b])
                vectors.append(data[a:b])
        if ids:
            yield packed(shard, np.concatenate(ids), np.concatenate(least), np.concatenate(vectors))

    dealt = (classes.select(F.pmod(F.xxhash64("node"), F.lit(shards)).alias("shard"), "node", "least", "vector")
             .repartition(max(min(shards, TASKS), 1), "shard").sortWithinPartitions("shard", F.xxhash64("node", F.lit(2))))
    return written(dealt.mapInArrow(run, "shard bigint, n bigint, name string"), "graphs")


def _rows(column) -> np.ndarray:
    """Rows of an Arrow list column in its own kind of numbers."""
    rows = matrix(column)
    return rows.astype(np.float32) if column.type.value_type == pa.float32() else rows


def _blocks(queries: DataFrame, folder: str) -> DataFrame:
    """(n, name): files of at most BLOCK queries (vec_id, vector), as a task meets them."""

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                name = blocks.save(folder, ids=part.column(0).to_numpy(), vectors=_rows(part.column(1)))
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "name": [name]})

    return queries.select("vec_id", "vector").mapInArrow(pack, "n bigint, name string")


def _best(queries: np.ndarray, found: list[list[tuple]], most: int):
    """Of the classes (node, least, score) found for each query, the ``most`` best that do not begin with the query itself,
    and all that do: whether these have other ids is not known here."""
    for query_id, parts in zip(queries, found):
        node, least, score = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((least, -score))
        own = least[order] == query_id
        order = order[own | (np.cumsum(~own) <= most)]
        yield np.full(len(order), query_id), node[order], score[order]


def search(graphs: DataFrame, queries: DataFrame, folder: str, *, most: int, width: int = WIDTH) -> DataFrame:
    """(query_id, node, score): for each query (vec_id, vector) the best classes of every range of shards, taken from the
    ``most`` best of each shard; of equally near ones those with the smallest vec_id."""
    spark = graphs.sparkSession
    shards = [r[0] for r in graphs.orderBy("shard").select("name").collect()]  # one per SHARD vectors
    packs = written(_blocks(queries, folder), "query-names").orderBy("n", "name").collect()  # at most one per BLOCK queries and task
    asked = blocks.dealt([tuple(r) for r in packs], BLOCK)
    step = max(1, min(RANGE, len(shards) * len(asked) // UNITS))
    ranges = -(-len(shards) // step)
    count = len(asked) * ranges
    units = spark.range(0, count, 1, max(1, min(count, TASKS)))

    def run(batches):
        for batch in batches:
            for unit_number in batch.column(0).to_pylist():
                block, first = unit_number // ranges, unit_number % ranges * step
                parts = [blocks.load(folder, name) for name in asked[block]]
                ids, wanted = (np.concatenate([p[k] for p in parts]) for k in ("ids", "vectors"))
                wanted = unit(wanted.astype(np.float64))
                found: list[list[tuple]] = [[] for _ in ids]
                for name in shards[first:first + step]:
                    data = blocks.load(folder, name)
                    nodes, least, scaled = data["ids"], data["least"], unit(data["vectors"].astype(np.float64))
                    high = sum(k.startswith("members") for k in data)
                    graph = Graph(scaled, [(data[f"members{at}"], data[f"links{at}"]) for at in range(high)])
                    for mine, query in zip(found, wanted):
                        near = np.array([n for _, n in graph.search(query, max(width, most))], np.int64)
                        score = np.einsum("ij,j->i", scaled[near], query)
                        order = np.lexsort((least[near], -score))[:most]
                        mine.append((nodes[near[order]], least[near[order]], score[order]))
                columns = [np.concatenate(x) for x in zip(*_best(ids, found, most))]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                                  pa.array(columns[2], pa.float64())], ["query_id", "node", "score"])

    return units.mapInArrow(run, "query_id bigint, node bigint, score double")


def nearest(rows: DataFrame, asked: "F.Column", *, neighbours: int = 5, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every row where ``asked`` holds.

    Nearness is the largest cosine, in double precision on the original vectors; ties go to the
    smaller vec_id, and rows of one class all tie. The query's own id is no candidate. With
    fewer candidates all are returned. Vectors that are null, empty or zero, or hold a null or
    non-finite component, and rows without a vec_id, take no part; vectors of another length
    than the query are no candidates. Rows that repeat id and vector count once. Every row is
    indexed; which neighbours are found depends on the graphs (recall is measured in the tests).
    """
    good = (written(keyed(rows.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding")), "vectors")
            .where("ok").drop("ok").withColumn("vec_id", F.col("vec_id").cast("bigint")))
    # of a class only its smallest ids can be among the nearest: one more than asked for, in case one is the query
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    ids = (good.select("k1", "k2", "vec_id").distinct().withColumn("r", F.row_number().over(first))
           .where(F.col("r") <= neighbours + 1))
    heads = written(ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "heads")
    # ids may repeat with other vectors: a class is named by a number of its own
    heads = heads.withColumn("node", F.xxhash64("k1", "k2"))
    classes = written(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.any_value("vector").alias("vector"))
                      .select(F.xxhash64("k1", "k2").alias("node"), "least", "vector", F.size("vector").alias("dims")), "classes")
    queries = written(good.where(asked).dropDuplicates(["vec_id", "k1", "k2"]).select("vec_id", "vector"), "queries")
    folder = fresh_path(rows.sparkSession, "shards")
    found = None
    for dims, count in sorted(tuple(r) for r in classes.groupBy("dims").count().collect()):  # a row per length
        graphs = build(classes.where(F.col("dims") == dims), -(-count // shard), folder)
        # written: the size of what comes from a few numbers of units is not to be guessed, or it is broadcast
        part = written(search(graphs, queries.where(F.size("vector") == dims), folder, most=neighbours + 1, width=width), "found")
        found = part if found is None else found.union(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.join(heads.select("node", "ids"), "node")
            .select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
