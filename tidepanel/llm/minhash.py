"""Near-duplicate texts: universal hash minima, banding, verification, components.

1. Each text becomes a set of word shingles (64-bit hashes). Texts with equal sets are one
   class, so copies are folded before anything else looks at them.
2. A class has HASHES minima; BANDS groups of them are the buckets it falls in.
3. Pairs within a bucket are first compared by their minima, then by their full sets.
4. A bucket is not expanded into all its pairs: members are compared with one centre of the
   bucket, components are formed, and only pairs whose members are still in different
   components are compared in the next round. The last round compares every pair left, block by
   block inside tasks, and returns no pairs but one link for two components.
5. Shingles that no other candidate has bound what a class can share with any other. Classes
   and pairs that cannot reach the threshold by that bound are left out; this loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidepanel.llm.common import each_utf8, small_batches, spare
from tidepanel.llm.components import components
from tidepanel.session import written

BANDS, DEPTH = 32, 5  # a pair at 0.8 meets in no bucket with probability 3e-6
HASHES = BANDS * DEPTH
SLACK = 16  # points below the threshold at which the minima rule a pair out: five deviations
BROADCAST_ROWS = 1_000_000  # ids of 8 bytes; more are joined by a shuffle
STAR_ROUNDS = 2
BLOCK = 128  # members of a bucket compared with as many others at a time
OUT_BYTES = 2_000_000  # sets of a task given back at a time

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, (2, HASHES), np.uint64)
_FACTOR, _ADDEND = _RANDOM[0] | np.uint64(1), _RANDOM[1]


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; A-Z lower-cased, words split at ASCII white space.

    A text with fewer words is one shingle of all its words; without words the set is empty.
    """
    import xxhash

    split = data.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    width = min(words, len(split))
    runs = len(split) - width + 1
    mixed = np.full(runs, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashed[i:i + runs]) * _ODD
        mixed ^= mixed >> _SHIFT
    return np.unique(mixed)


def minima(found: np.ndarray) -> np.ndarray:
    """Smallest value of each universal hash, top 32 bits."""
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(low, (np.multiply.outer(_FACTOR, found[i:i + 1024]) + _ADDEND[:, None]).min(axis=1), out=low)
    return (low >> _SHIFT).astype(np.uint32)


def buckets(low: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band; the band is part of it."""
    part = low.reshape(BANDS, DEPTH).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for i in range(DEPTH):
        key = (key ^ part[:, i]) * _ODD
        key ^= key >> _SHIFT
    return key.view(np.int64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's fingerprint, buckets (none for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        for batch in batches:
            sizes, first, second, keys, ends = [], [], [], [], [0]
            for data in each_utf8(batch.column(1)):
                found = shingles(data, words)
                print_ = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                first.append(int.from_bytes(print_[:8], "little", signed=True))
                second.append(int.from_bytes(print_[8:], "little", signed=True))
                if len(found):
                    keys.append(buckets(minima(found)))
                ends.append(len(keys) * BANDS)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                 pa.array(second, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "fp1", "fp2", "keys"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, fp1 bigint, fp2 bigint, keys array<bigint>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, minima and the whole set."""

    def run(batches):
        for batch in batches:
            start, found, held = 0, [], 0
            for i, data in enumerate(each_utf8(batch.column(1))):
                found.append(shingles(data, words))
                held += found[-1].nbytes
                if held >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(found)), pa.array([minima(f).tobytes() for f in found], pa.binary()),
                         pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["node", "low", "members"])
                    start, found, held = i + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"node {kind}, low binary, members array<bigint>")


@F.arrow_udf(BooleanType())
def _alike_minima(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint32).reshape(-1, HASHES) for v in (a, b))
    return pa.array((x == y).sum(axis=1) * 100 >= least.to_numpy() * HASHES)


@F.arrow_udf(BooleanType())
def _alike_sets(a: pa.Array, b: pa.Array, percent: pa.Array) -> pa.Array:
    def same(left, right, p):
        if 100 * min(len(left), len(right)) < p * max(len(left), len(right)):
            return False
        both = np.sort(np.concatenate([left, right]))
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= p * (len(both) - shared)

    (x, at), (y, to) = ((v.values.to_numpy(), v.offsets.to_numpy().tolist()) for v in (a, b))
    return pa.array([same(x[at[i]:at[i + 1]], y[to[i]:to[i + 1]], p) for i, p in enumerate(percent.to_pylist())], pa.bool_())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold: minima first, then the full sets."""
    low = sets.select("node", "low")
    near = (pairs.join(low.withColumnsRenamed({"node": "a", "low": "x"}), "a")
            .join(low.withColumnsRenamed({"node": "b", "low": "y"}), "b")
            .where(_alike_minima("x", "y", F.lit(percent - SLACK))).select("a", "b"))
    full = sets.select("node", "members")
    return written(near.join(full.withColumnsRenamed({"node": "a", "members": "x"}), "a")
                   .join(full.withColumnsRenamed({"node": "b", "members": "y"}), "b")
                   .where(_alike_sets("x", "y", F.lit(percent))).select("a", "b").distinct(), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bounds(sets: DataFrame) -> DataFrame:
    """(node, n, free): size of each set, and how many of its shingles another node has too."""
    alone = (sets.select("node", F.explode("members").alias("m")).groupBy("m")
             .agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
             .groupBy("node").count())
    size = F.size("members")
    sizes = sets.groupBy("node").agg(F.min(size).alias("n"), F.max(size).alias("most"), F.count(F.lit(1)).alias("texts"))
    one = F.col("n") - F.coalesce("count", F.lit(0))  # an id with several texts is not bounded
    return sizes.join(alone, "node", "left").select("node", "n", F.when(F.col("texts") == 1, one).otherwise(F.col("most")).alias("free"))


def _possible(percent: int, a: str, b: str) -> "F.Column":
    """False for pairs that cannot reach the threshold: they share at most the smaller ``free``."""
    most = F.least(f"{a}.free", f"{b}.free")
    return most * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


def _linked(places: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) over all links between members (key, node, n, free) of a bucket."""
    spark = places.sparkSession
    kind = places.schema["node"].dataType.simpleString()
    roots = spark.createDataFrame([], f"node {kind}, root {kind}")

    def grown(roots: DataFrame, links: DataFrame) -> DataFrame:
        """Roots after more links: components of the roots, then carried to the nodes."""
        of = roots.withColumnRenamed("root", "r")
        ends = links.join(of.withColumnsRenamed({"node": "a", "r": "ra"}), "a", "left").join(
            of.withColumnsRenamed({"node": "b", "r": "rb"}), "b", "left")
        more = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        moved = more.select(F.col("node").alias("root"), F.col("root").alias("to"))
        old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return written(old.union(more.join(roots, "node", "left_anti")), "roots")

    def centres(rows: DataFrame, rank, *more) -> DataFrame:
        return rows.groupBy("key").agg(F.min(F.struct(rank.alias("h"), "node", "n", "free", *more)).alias("c"))

    # each member against the first centre among its buckets
    centre = centres(places, F.xxhash64("node"))
    first = (places.alias("p").join(centre, "key").where("p.node <> c.node").where(_possible(percent, "p", "c"))
             .groupBy(F.col("p.node").alias("a")).agg(F.min("c").alias("c")).select("a", F.col("c.node").alias("b")))
    roots = grown(roots, _confirmed(_ordered(first), sets, percent))

    def still_mixed(places: DataFrame) -> DataFrame:
        named = places.join(roots, "node", "left").select(
            "key", "node", "n", "free", F.coalesce("root", "node").alias("root"))
        mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                         F.count(F.lit(1)).alias("held")).where("lo < hi")
        return written(named.join(mixed.select("key", "held"), "key"), "places")

    # every member against a centre of each of its buckets, if that is in another component
    for turn in range(1, STAR_ROUNDS + 1):
        named = still_mixed(places)
        centre = centres(named, F.xxhash64("node", "key", F.lit(turn)), "root")
        pairs = (named.alias("p").join(centre, "key").where("p.root <> c.root").where(_possible(percent, "p", "c"))
                 .select(F.col("p.node").alias("a"), F.col("c.node").alias("b")))
        roots = grown(roots, _confirmed(_ordered(pairs), sets, percent))
        # of two members the one pair is decided now
        places = named.where("held > 2").select("key", "node", "n", "free")
    return grown(roots, _tiled(still_mixed(places), sets, percent))


def _tiled(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within the buckets of ``named``: every pair, compared inside tasks.

    The members of a bucket stand in the order of their components and are cut into blocks of
    BLOCK. A task compares two blocks at a time and returns one link for each pair of components
    it finds linked. Blocks within one component (``first`` to ``last``) are not compared with
    each other, so that the many members of a large one only meet those of others.
    """
    before = Window.partitionBy("key").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    to = F.col("before") + F.col("size")
    of = (named.groupBy("key", "root", "held").agg(F.count(F.lit(1)).alias("size"))
          .withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
          .select("key", "root", "before", "size", blocks.alias("blocks"), F.ceil(F.col("before") / BLOCK).cast("int").alias("first"),
                  F.when(to == F.col("held"), blocks - 1).otherwise(F.floor(to / BLOCK).cast("int") - 1).alias("last")))
    own = F.floor((F.col("before") + F.pmod(F.xxhash64("node", "key"), F.col("size"))) / BLOCK).cast("int")
    none = F.array().cast("array<int>")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.concat(F.when(F.col("first") > 0, F.sequence(F.lit(0), F.col("first") - 1)).otherwise(none),
                      F.when(F.col("last") < F.col("blocks") - 1, F.sequence(F.col("last") + 1, F.col("blocks") - 1)).otherwise(none))
    partners = F.when(F.col("own").between(F.col("first"), F.col("last")), others).otherwise(every)
    sides = F.transform(partners, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    tiles = (named.drop("held").join(of, ["key", "root"]).withColumn("own", own)
             .select("key", "node", "root", "own", F.inline(sides)).join(sets, "node")
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
             .select("key", "i", "j", "own", "root", "low", "members"))
    kind = named.schema["root"].dataType.simpleString()

    def compare(batches):
        tile, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(7))):
                here = tuple(x.as_py() for x in row[:3])
                if here != tile:
                    yield from found(tile, rows)
                    tile, rows = here, []
                rows.append((row[3].as_py(), row[4].as_py(), np.frombuffer(row[5].as_buffer(), np.uint32),
                             row[6].values.to_numpy()))
        yield from found(tile, rows)

    def found(tile, rows):
        if tile is None or len({r[1] for r in rows}) < 2:
            return
        left = [r for r in rows if r[0] == tile[1]]
        right = left if tile[1] == tile[2] else [r for r in rows if r[0] == tile[2]]
        pairs = _linked_roots(left, right, percent)
        if pairs:
            a, b = zip(*sorted(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a, out), pa.array(b, out)], ["a", "b"])

    out = pa.int32() if kind == "int" else pa.int64()
    return written(tiles.mapInArrow(compare, f"a {kind}, b {kind}").distinct(), "links")


def _linked_roots(left: list, right: list, percent: int) -> set[tuple]:
    """Pairs of roots with a link between members (block, root, minima, set) of ``left`` and ``right``."""
    if not left or not right:
        return set()
    low_a, low_b = np.stack([r[2] for r in left]), np.stack([r[2] for r in right])
    near = np.stack([(low_b == row).sum(axis=1) for row in low_a]) * 100 >= (percent - SLACK) * HASHES
    near &= np.array([[x[1] != y[1] for y in right] for x in left])
    use_a, use_b = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
    if not len(use_a):
        return set()
    members = [left[i] for i in use_a] + [right[j] for j in use_b]
    sizes = np.array([len(r[3]) for r in members])
    names, token = np.unique(np.concatenate([r[3] for r in members]), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), sizes)
    shared = np.zeros((len(use_a), len(use_b)), np.float32)
    for start in range(0, len(names), 4096):  # counts are below 2**24, where such sums are exact
        part = (token >= start) & (token < start + 4096)
        held = np.zeros((len(members), 4096), np.float32)
        held[owner[part], token[part] - start] = 1
        shared += held[:len(use_a)] @ held[len(use_a):].T
    total = sizes[:len(use_a), None] + sizes[None, len(use_a):]
    linked = (100 * shared >= percent * (total - shared)) & near[np.ix_(use_a, use_b)]
    return {tuple(sorted((left[use_a[i]][1], right[use_b[j]][1]))) for i, j in zip(*np.nonzero(linked))}


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two texts are linked when 100 * intersection >= percent * union of their sets of shingles.
    ``component_id`` is the smallest doc_id reachable over links; ``kept`` marks it. Null and
    empty texts, and texts of white space, have an empty set and no link. Rows that share a
    doc_id count as one document, with the links of all its texts. Rows with a null doc_id
    take part as members of their class: they get its component, and none are kept when it has
    other ids. Other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    sketches = written(_sketches(docs, words), "sketches")
    classes = written(sketches.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"))
                      .where("node is not null"), "classes")
    places = (sketches.where("n_shingles > 0").withColumnRenamed("doc_id", "node")
              .join(classes, ["fp1", "fp2", "node"]).select(F.explode("keys").alias("key"), "node").distinct())
    shared = places.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    places = written(places.join(shared.select("key"), "key"), "places")
    nodes = written(places.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    sets = written(_sets(docs.select("doc_id", "text").join(nodes, "doc_id"), words), "sets")
    able = written(_bounds(sets).where(F.col("free") * 100 >= F.col("n") * percent), "bounds")
    roots = _linked(written(places.join(able, "node"), "places"), sets, percent)
    return (sketches.join(classes, ["fp1", "fp2"], "left").join(roots, "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.coalesce("root", "node", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every group of near copies; columns as they came.

    Each row is a document of its own, so repeated rows, rows with a null doc_id and the texts of a
    shared doc_id are compared like any others. Of a group the row with the smallest doc_id stays
    (a null one last), then the smallest text hash, then any of equal rows. Rows without words all stay.
    """
    row = spare(docs, "row_number")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    near = near_duplicates(docs.select(F.col(row).alias("doc_id"), "text"), words=words, percent=percent)
    near = written(near.where("not kept").select("doc_id", "component_id"), "gone")
    # the rows of every group of several: those above and the one that names the group
    members = near.union(near.select("component_id", "component_id").distinct()).toDF("row", "group")
    rows = docs.select(F.col(row).alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"))
    stays = (members.join(rows, "row").groupBy("group")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row")).alias("least")).select("least.row"))
    gone = written(members.select("row").join(stays, "row", "left_anti"), "gone").withColumnRenamed("row", row)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row, "left_anti").drop(row)
