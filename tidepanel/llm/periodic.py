"""Periodic runs of words: maximal stretches that repeat themselves at a distance of q words.

Scale-tiled. The periods are taken by octave [P, 2P). In octave P a document is cut at every
multiple of P; the tile of a cut reaches max(2P, 12) words to its left and 2P more than that to its
right, so tiles overlap and every run crosses a cut of its octave with a whole period to the
right of it. A tile is solved alone: the Z-function of the words from the cut on, and that
of the words before it read backwards, give for every q how far period q holds on both sides. What a
tile finds of a run is a fragment, cut off where the tile ends; neighbouring fragments of one run overlap by q words
or more. Fragments are shuffled by (document, period) and stitched.

Tiles that cannot hold a fragment are not built: a run of octave P has a gram of ``_gram(P)`` words that
comes again less than 2P words later, and equal grams have equal hashes.

Null and empty texts have no words and no runs. Rows are told apart by a key of their own, so
repeated rows and null ids each have their own result. Only ``doc_id`` and ``text`` are read; other columns
may have any name. A document is one row and is hashed in one task; its tiles spread over all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.session import written

LEAST = 12  # words of the shortest run
CHUNK = 4_096  # words between the first and the last cut of tiles that travel together
FLUSH = 2 << 20  # bytes of output handed on at a time
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """Stretches without space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().split()


# ---- which tiles can hold a fragment ----------------------------------------
def _gram(p: int) -> int:
    """Words i in a row with word i = word i + q that every run of a period in [p, 2p) has."""
    return min(max(LEAST - q, q) for q in range(p, 2 * p)) if p < LEAST else p


def _reach(p: int) -> int:
    return max(2 * p, LEAST)


class _Grams:
    """Hashes of all grams of a length, built by doubling; wrapping 64-bit arithmetic."""

    def __init__(self, ids: np.ndarray):
        one = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        one ^= one >> np.uint64(29)
        self.powers = {1: one * np.uint64(0xBF58476D1CE4E5B9)}

    def of(self, length: int) -> np.ndarray:
        if length in self.powers:
            return self.powers[length]
        if length & (length - 1) == 0:
            half = self.of(length // 2)
            self.powers[length] = self._joined(half, half, length // 2)
            if length > 16:  # shorter ones are asked for again
                del self.powers[length // 2]
            return self.powers[length]
        left = 1 << (length.bit_length() - 1)
        return self._joined(self.of(left), self.of(length - left), left)

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        n = max(len(right) - shift, 0)
        return left[:n] * np.uint64(pow(_BASE, shift, 1 << 64)) + right[shift:shift + n]


def _again(codes: np.ndarray, places: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``places`` (rising): those whose code comes again, and those where it does so before ``within``."""
    order = np.argsort(codes[places], kind="stable")
    at = places[order]
    same = codes[at][1:] == codes[at][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    near = np.append(same & (np.diff(at) < within), False) if len(at) else same
    return np.sort(at[repeated]), np.sort(at[near])


def flagged(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, cuts whose tiles may hold a fragment), octaves with none left out."""
    n = len(ids)
    if n < LEAST:
        return
    grams = _Grams(ids)
    six = _gram(4)
    codes = grams.of(six)
    alive, near = _again(codes, np.arange(len(codes)), 8)
    if not len(alive):
        return
    p = 1
    while 2 * p <= n:
        length = _gram(p)
        if p != 4:
            codes = grams.of(length)
            places, near_here = _again(codes, alive[alive < len(codes)], 2 * p)
        else:
            places, near_here = alive, near
        if p >= 8:
            alive = places
            if not len(alive):
                return
        if len(near_here):
            cuts = np.arange(0, n, p)
            hit = np.searchsorted(near_here, cuts, "right") > np.searchsorted(near_here, cuts - length, "left")
            if hit.any():
                yield p, cuts[hit]
        p *= 2


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(octave, first word, cuts counted from it, the words): tiles of neighbouring cuts share one row."""
    for p, cuts in flagged(ids):
        reach = _reach(p)
        breaks = np.flatnonzero(np.diff(cuts) > 2 * reach + 2 * p) + 1
        for group in np.split(cuts, breaks):
            for part in np.split(group, np.searchsorted(group, np.arange(group[0] + CHUNK, group[-1] + 1, CHUNK))):
                if len(part):
                    first = max(int(part[0]) - reach, 0)
                    yield p, first, part - first, ids[first:int(part[-1]) + 2 * p + reach]


# ---- solving a tile ---------------------------------------------------------
def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _prime_factors(q: int) -> tuple[int, ...]:
    found, r = [], 2
    while r * r <= q:
        if q % r == 0:
            found.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return (*found, q) if q > 1 else tuple(found)


def solve(p: int, cut: int, ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the fragments across ``cut``; periods in [p, 2p), the smallest of their stretch."""
    reach = _reach(p)
    low, high = max(cut - reach, 0), min(cut + 2 * p, len(ids))
    ahead = z_function(ids[cut:cut + 2 * p + reach])
    before = ids[low:cut][::-1]
    back = z_function([*before, -1, *ids[low:high][::-1]])
    shift = len(before) + 1 + high
    for q in range(p, min(2 * p, high - cut + 1)):
        right = min(ahead[q], reach) if q < len(ahead) else 0
        left = min(back[shift - cut - q], reach) if shift - cut - q < len(back) else 0
        if left + right + q < max(LEAST, 2 * q):
            continue
        # the block from the cut on has a smaller period that divides q
        if any(ahead[q // r] >= q - q // r for r in _prime_factors(q)):
            continue
        yield q, cut - left, cut + q + right


# ---- Spark ------------------------------------------------------------------
_PREPARED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("digest", T.StringType()),
    T.StructField("words", T.BinaryType()), T.StructField("octave", T.IntegerType()),
    T.StructField("first", T.IntegerType()), T.StructField("cuts", T.BinaryType()),
    T.StructField("ids", T.BinaryType())])


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes in bytes -> batches of about FLUSH bytes."""
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 64
        if size >= FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _prepared(docs: DataFrame, texts: bool) -> DataFrame:
    """A row per document (octave null; the words only where they are needed again) and a row per group of tiles."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string"))
    out = T.StructType([*keyed.schema.fields[:2], *_PREPARED.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)

        def rows(batch):
            for row, doc, text in zip(*(batch.column(i) for i in range(3))):
                words = words_of(text.as_py())
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                joined, found = b" ".join(words), False
                own = {"row": row.as_py(), "doc_id": doc.as_py()}
                for octave, first, cuts, part in tiles(ids):
                    found = True
                    yield own | {"octave": octave, "first": first, "cuts": cuts.astype(np.int32).tobytes(),
                                 "ids": part.tobytes()}, part.nbytes + 4 * len(cuts)
                keep = found or texts
                yield own | {"n_words": len(words), "digest": None if keep else hashlib.sha256(joined).hexdigest(),
                             "words": joined if keep else None}, len(joined) if keep else 0

        for batch in batches:
            yield from _batches(rows(batch), schema)

    return written(keyed.mapInArrow(run, out), "tiles")


def _fragments(prepared: DataFrame) -> DataFrame:
    """(row, period, start, end), tiles dealt over all tasks."""
    # small rows with much work behind them: a stated number of tasks is not lowered by their bytes
    tasks = int(prepared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles_ = (prepared.where("octave is not null").select("row", "octave", "first", "cuts", "ids")
              .repartition(tasks, F.xxhash64("row", "octave", "first")))

    def run(batches):
        schema = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

        def rows(batch):
            for row, octave, first, cuts, ids in zip(*batch.columns):
                words = np.frombuffer(ids.as_buffer(), np.int32).tolist()
                own, at = row.as_py(), first.as_py()
                for cut in np.frombuffer(cuts.as_buffer(), np.int32).tolist():
                    for period, start, end in solve(octave.as_py(), cut, words):
                        yield {"row": own, "period": period, "start": at + start, "end": at + end}, 0

        for batch in batches:
            yield from _batches(rows(batch), schema)

    return tiles_.mapInArrow(run, "row long, period long, start long, end long")


def stitched(fragments: DataFrame) -> DataFrame:
    """(row, period, start, end) of whole runs. Fragments of one period that share ``period`` words
    or more belong to one run; a stretch found with several periods has the smallest."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(seen - F.col("start") >= F.col("period"), 0).otherwise(1)
    return (fragments.withColumn("opens", opens)
            .withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("row", "start", "end").agg(F.min("period").alias("period")))


RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def scan(docs: DataFrame, *, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed, collapsed_sha256.

    ``runs`` (start, period, length; by start, then period) are the stretches of at least 12 words and two periods that
    no neighbouring word prolongs. ``collapsed`` holds the words that no run repeats, joined by
    one space; with ``texts=False`` it is null and only its digest is given.
    """
    prepared = _prepared(docs, texts)
    runs = stitched(_fragments(prepared)).groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "period", (F.col("end") - F.col("start")).alias("length")))).cast(RUNS).alias("runs"))
    whole = prepared.where("octave is null").select("row", "doc_id", "n_words", "digest", "words")
    none = F.array().cast(RUNS)
    plain = whole.where("words is null").select(
        "doc_id", "n_words", none.alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("digest").alias("collapsed_sha256"))
    held = whole.where("words is not null").drop("digest").join(runs, "row", "left").select(
        "doc_id", "n_words", "words", F.coalesce("runs", none).alias("runs"))
    out = T.StructType([f for f in plain.schema.fields])

    def collapse(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)

        def rows(batch):
            for doc, n, words, found in zip(*batch.columns):
                split, runs_ = words.as_py().split(), found.as_py()
                edge = np.zeros(len(split) + 1, np.int64)
                for r in runs_:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                dropped = np.cumsum(edge[:-1]) > 0
                left = b" ".join(w for w, gone in zip(split, dropped.tolist()) if not gone)
                yield {"doc_id": doc.as_py(), "n_words": n.as_py(), "runs": runs_,
                       "collapsed": left.decode() if texts else None,
                       "collapsed_sha256": hashlib.sha256(left).hexdigest()}, 100 * len(runs_) + texts * len(left)

        for batch in batches:
            yield from _batches(rows(batch), schema)

    return held.mapInArrow(collapse, out).unionByName(plain)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of what is left."""
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))),
        F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth text (by crc32 of its id) with its tail replaced by a stretch that repeats.

    With h = crc32 of the id in decimal and g = h div 10, texts with h mod 10 = 0 keep the words before a = g mod n; each
    later word i becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). A null id changes nothing.
    """
    turn = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), turn.alias("h"))
    out = T.StructType(rows.schema.fields[:2])

    def run(batches):
        for batch in batches:
            turns = batch.column(2).to_pylist()
            picked = [i for i, h in enumerate(turns) if h is not None and h % 10 == 0]
            text = batch.column(1)
            if picked:
                pieces, last = [], 0
                for i in picked:
                    pieces += [text.slice(last, i - last), pa.array([_loop(text[i].as_py(), turns[i] // 10)], text.type)]
                    last = i + 1
                text = pa.concat_arrays([*pieces, text.slice(last)])
            yield pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "text"])

    return rows.mapInArrow(run, out)


def _loop(text: str | None, g: int) -> str | None:
    words = words_of(text)
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    tail = block * ((n - a) // p + 1)
    return b" ".join(words[:a] + tail[:n - a]).decode()
