"""Exact removal of long repeats with a logarithmic family of suffix arrays.

A string of LENGTH bytes that starts at two places is removed at all its places.

1. Anchors. Of the GRAM-byte substrings of a window of LENGTH bytes the one with the smallest
   hash, leftmost among equals, is the window's anchor. Equal windows have their anchor at the
   same place, so the windows of one anchor (a *run*, about 75 window starts) need only be compared
   with runs of an anchor of the same hash. One row per run; runs whose hash occurs once are done.
2. Hashes whose runs are all the same bytes are done as well: everything in them repeats.
3. The other runs are fetched, one per distinct content, and dealt to shards by their hash. In a
   shard they come in batches. The window starts of a batch are sorted by the LENGTH bytes after
   them, a suffix array cut at that depth; equal neighbours are repeats. The batch is then looked
   up in the existing levels, and levels of equal size are merged, as in a binary counter.
4. A hash with more than HOT_BYTES of distinct runs does not fit one shard. Its runs are cut where
   the second smallest gram of the window changes, and dealt again by both; then by the four, eight, ...
   smallest. Only windows that agree in all of these and still do not fit are counted by a 128-bit hash.

Python workers hold one text and a few megabytes of rows at a time; a level keeps its text and
two numbers for each window, and is compared strip by strip.

Spans go back to the documents, are merged there, and the rest of the text is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import each_utf8, small_batches, spare
from tidepanel.session import written

LENGTH = 200
GRAM = 48
CHUNK = 1 << 17  # window starts of a text looked at together; their numbers take 20 bits
BATCH_BYTES = 128_000
STRIP = 4096  # strings of a level written out at a time
SHARD_BYTES = 1_000_000
HOT_BYTES = 2_000_000
DEPTHS = (2, 4, 8, 16, 32)  # smallest grams of a window that deal a hot hash again
OUT_BYTES = 2_000_000  # rows of a task given back at a time
BROADCAST_BYTES = 48_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S = np.uint64(31)
_LOW = np.uint64((1 << 20) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> _S
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every place, from hashes of 8, 16 and 32 bytes."""
    eight = _mixed(np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy())
    sixteen = _mixed(eight[:-8] * _M2 + eight[8:])
    both = _mixed(sixteen[:-16] * _M2 + sixteen[16:])
    whole = both[:len(data) - GRAM + 1] * _M3 + sixteen[32:32 + len(data) - GRAM + 1]
    return _mixed(whole)


def runs(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of window starts) of the runs of a text."""
    count = len(data) - length + 1
    out: list[tuple] = []
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, max(count, 0), CHUNK):
        starts = min(CHUNK, count - base)
        hashed = gram_hashes(whole[base:base + starts + length - 1])
        low = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
        wide, done = length - GRAM + 1, 1
        while done * 2 <= wide:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < wide:
            low = np.minimum(low[:len(low) - (wide - done)], low[wide - done:])
        at = (low & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
        out.append((hashed[at[first]].view(np.int64), first + base, np.diff(np.append(first, starts))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- suffix arrays -----------------------------------------------------------------------

class Level:
    """Text and the places in it, sorted by the ``length`` bytes that follow; no two alike."""

    def __init__(self, text: np.ndarray, places: np.ndarray, names: np.ndarray, units: int):
        self.text, self.places, self.names, self.units = text, places, names, units


def _strings(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes after each place, with an end mark so that closing zeros count."""
    rows = np.full((len(places), length + 1), 255, np.uint8)
    rows[:, :length] = np.lib.stride_tricks.sliding_window_view(text, length)[places]
    return rows.view(f"S{length + 1}").ravel()


def _upto(level: Level, at: int, last: bytes, length: int) -> int:
    """First number from ``at`` whose string is above ``last``."""
    low, high = at, len(level.places)
    while low < high:
        mid = (low + high) // 2
        place = level.places[mid]
        if level.text[place:place + length].tobytes() <= last:
            low = mid + 1
        else:
            high = mid
    return low


def _lookup(held: Level, asked: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``asked`` its number in ``held`` and whether it is there; both are passed once, in strips."""
    count = len(asked.places)
    at, found, done = np.full(count, len(held.places)), np.zeros(count, bool), 0
    for start in range(0, len(held.places), STRIP):
        strip = _strings(held.text, held.places[start:start + STRIP], length)
        last = held.places[min(start + STRIP, len(held.places)) - 1]
        upto = _upto(asked, done, held.text[last:last + length].tobytes(), length)
        for first in range(done, upto, STRIP):
            here = slice(first, min(first + STRIP, upto))
            strings = _strings(asked.text, asked.places[here], length)
            to = np.searchsorted(strip, strings)
            at[here], found[here] = start + to, strip[to] == strings
        done = upto
        if done == count:
            break
    return at, found


def _merged(a: Level, b: Level, length: int) -> Level:
    """One level of both: ``b`` has no string of ``a``."""
    to, _ = _lookup(a, b, length)
    return Level(np.concatenate([a.text, b.text]), np.insert(a.places, to, b.places + len(a.text)),
                 np.insert(a.names, to, b.names), a.units + b.units)


class SuffixLevels:
    """Family of suffix arrays: each holds twice the batches of the one before it.

    ``add`` takes a text and window starts with names (numbers); ``repeated`` has the names of
    all windows whose bytes were seen at another place.
    """

    def __init__(self, length: int = LENGTH):
        self.length, self.levels, self._hits = length, [], []

    def add(self, text: np.ndarray, places: np.ndarray, names: np.ndarray) -> None:
        strings = _strings(text, places, self.length)
        order = np.argsort(strings, kind="stable")
        strings, places, names = strings[order], places[order], names[order]
        same = strings[1:] == strings[:-1]
        if same.any():
            self._hits += [names[1:][same], names[:-1][same]]
        first = np.concatenate([[True], ~same])
        new = Level(text, places[first], names[first], 1)
        for level in self.levels:  # scan against the existing levels
            at, found = _lookup(level, new, self.length)
            self._hits += [level.names[at[found]], new.names[found]]
            new = Level(text, new.places[~found], new.names[~found], 1)
        while self.levels and self.levels[-1].units == new.units:
            new = _merged(self.levels.pop(), new, self.length)
        self.levels.append(new)

    def repeated(self) -> np.ndarray:
        return np.unique(np.concatenate(self._hits)) if self._hits else np.zeros(0, np.int64)


# --- jobs ----------------------------------------------------------------------------------

def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k"),
                       F.octet_length(text).cast("long").alias("n"))


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    """(k, n, g, fp, p, w): every run of every text; g anchor hash, fp hash of its bytes, w window starts."""

    def packed(parts):
        return pa.RecordBatch.from_arrays([pa.array(a) for a in np.concatenate(parts, axis=1)], ["k", "n", "g", "fp", "p", "w"])

    def find(batches):
        import xxhash

        parts, held = [], 0
        for batch in batches:
            for data, k in zip(each_utf8(batch.column(0)), batch.column(1).to_pylist()):
                g, p, w = runs(data, length)
                view = memoryview(data)
                fp = np.fromiter((xxhash.xxh3_64_intdigest(view[a:a + b + length - 1])
                                  for a, b in zip(p.tolist(), w.tolist())), np.uint64, len(p)).view(np.int64)
                parts.append(np.stack([np.full(len(g), k), np.full(len(g), len(data)), g, fp, p, w]))
                held += parts[-1].nbytes
                if held >= OUT_BYTES:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return docs.where(F.col("n") >= length).select("text", "k").mapInArrow(
        find, "k bigint, n bigint, g bigint, fp bigint, p bigint, w bigint")


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(g, fp, c, data): the bytes of the wanted runs (k, n, g, fp, c, p, w)."""
    lists = written(wanted.groupBy("k", "n").agg(F.collect_list(F.struct("g", "fp", "c", "p", "w")).alias("runs")), "wanted")

    def cut(batches):
        for batch in batches:
            rows = batch.column(1)
            ends, each = rows.offsets.to_numpy(), rows.values
            flat = [each.field(name) for name in ("g", "fp", "c")]
            p, w = each.field("p").to_numpy().tolist(), each.field("w").to_numpy().tolist()
            data, held, first = [], 0, int(ends[0])
            for i, text in enumerate(each_utf8(batch.column(0))):
                for r in range(ends[i], ends[i + 1]):
                    data.append(text[p[r]:p[r] + w[r] + length - 1])
                    held += len(data[-1])
                    if held >= OUT_BYTES or r + 1 == ends[-1]:
                        yield pa.RecordBatch.from_arrays([x.slice(first, len(data)) for x in flat] + [pa.array(data, pa.binary())],
                                                         ["g", "fp", "c", "data"])
                        data, held, first = [], 0, r + 1

    return _bounded(docs.select("k", "n", "text"), lists, 40 * 8).select("text", "runs").mapInArrow(
        cut, "g bigint, fp bigint, c bigint, data binary")


def _bounded(docs: DataFrame, lists: DataFrame, width: int, how: str = "inner") -> DataFrame:
    """Join on (k, n); the lists are broadcast only if their entries are few."""
    column = lists.columns[-1]
    rows, entries = lists.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    small = (rows * 64 + (entries or 0) * (width // 8)) <= BROADCAST_BYTES
    return docs.join(F.broadcast(lists) if small else lists, ["k", "n"], how)


def _split(pieces: DataFrame, depth: int, length: int) -> DataFrame:
    """Pieces cut where the ``depth`` smallest grams of the window change; ``key`` is made of their hashes."""
    names = ["g", "fp", "base", "key", "size", "data"]
    wide = length - GRAM + 1

    def cut(batches):
        rows, held = [], 0
        for batch in batches:
            for g, fp, base, data in zip(*(batch.column(i).to_pylist() for i in range(3)), each_utf8(batch.column(3))):
                hashed = gram_hashes(np.frombuffer(data, np.uint8))
                grams = np.lib.stride_tricks.sliding_window_view(hashed, wide)
                least = np.sort(np.partition(grams, min(depth, wide) - 1, axis=1)[:, :depth], axis=1)
                key = np.zeros(len(least), np.uint64)
                for column in least.T:
                    key = _mixed(key * _M2 + column)
                first = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]]).tolist()
                for i, j in zip(first[:-1], first[1:]):
                    part = data[i:j + length - 1]
                    rows.append((g, fp, base + i, int(key[i].view(np.int64)), len(part), part))
                    held += len(part)
                if held >= OUT_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary() if name == "data" else pa.int64()) for name, c in zip(names, zip(*rows))], names)

    return pieces.select("g", "fp", "base", "data").mapInArrow(
        cut, "g bigint, fp bigint, base bigint, key bigint, size bigint, data binary")


def _repeated_starts(found: DataFrame, length: int) -> DataFrame:
    """(g, fp, ends): first and last of the stretches of repeated window starts in the runs (g, fp, data)."""
    pieces = found.select("g", "fp", F.lit(0).cast("long").alias("base"), F.col("g").alias("key"),
                          F.octet_length("data").cast("long").alias("size"), "data")
    usual, total = [], 0
    for depth in [*DEPTHS, None]:
        weight = pieces.groupBy("key").agg(F.sum("size").alias("bytes"))
        hot = F.col("bytes") > HOT_BYTES
        fits, over = weight.agg(F.sum(F.when(~hot, F.col("bytes"))), F.count_if(hot)).first()
        total += fits or 0
        if not over:
            usual.append(pieces)
            return _by_levels(usual, max(1, -(-total // SHARD_BYTES)), length)
        hot = written(weight.where(hot).select("key"), "hot")
        usual.append(pieces.join(hot, "key", "left_anti").select(pieces.columns))
        pieces = pieces.join(hot, "key")
        if depth:
            pieces = written(_split(pieces, depth, length), "pieces")
    return _by_levels(usual, max(1, -(-total // SHARD_BYTES)), length).union(_by_counts(pieces, length))


def _by_levels(pieces: list[DataFrame], shards: int, length: int) -> DataFrame:
    """Repeated window starts of pieces (g, fp, base, key, data), found shard by shard."""

    def scan(batches):
        shard, held, size = None, [], 0
        levels, names, total = None, [], 0

        def flush():
            nonlocal held, size, total
            if not held:
                return
            text = np.frombuffer(b"".join(row[3] for row in held), np.uint8)
            sizes = np.array([len(row[3]) for row in held])
            counts = sizes - length + 1
            begins = np.cumsum(sizes) - sizes
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            levels.add(text, np.repeat(begins, counts) + inner, np.arange(counts.sum()) + total)
            names.extend((*row[:3], c) for row, c in zip(held, counts.tolist()))
            total += int(counts.sum())
            held, size = [], 0

        def results():
            flush()
            hits = levels.repeated()
            ends = np.cumsum([row[3] for row in names])
            parts = np.split(hits, np.searchsorted(hits, ends[:-1])) if names else []
            kept = [(g, fp, _stretches(h - (e - c) + base))
                    for (g, fp, base, c), e, h in zip(names, ends.tolist(), parts) if len(h)]
            for at in range(0, len(kept), 5000):
                g, fp, starts = zip(*kept[at:at + 5000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.int64()), pa.array(fp, pa.int64()), pa.array(starts, pa.list_(pa.int64()))],
                    ["g", "fp", "ends"])

        for batch in batches:
            for s, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), each_utf8(batch.column(4))):
                if s != shard:
                    if levels:
                        yield from results()
                    shard, levels, names, total = s, SuffixLevels(length), [], 0
                held.append(row)
                size += len(row[3])
                if size >= BATCH_BYTES:
                    flush()
        if levels:
            yield from results()

    every = pieces[0]
    for more in pieces[1:]:
        every = every.union(more)
    dealt = every.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "g", "fp", "base", "data")
    return (dealt.repartition("shard").sortWithinPartitions("shard", "g", "fp", "base")
            .mapInArrow(scan, "g bigint, fp bigint, ends array<bigint>"))


def _stretches(starts: np.ndarray) -> list[int]:
    """First and last of each stretch of consecutive numbers, one after the other."""
    cut = np.nonzero(np.diff(starts) > 1)[0]
    return np.column_stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]]).ravel().tolist()


def _by_counts(pieces: DataFrame, length: int) -> DataFrame:
    """The same for what no depth could split: windows are counted by a 128-bit hash."""

    def windows(batches):
        import xxhash

        for batch in batches:
            for row_g, row_fp, base, data in zip(*(batch.column(i).to_pylist() for i in range(3)), each_utf8(batch.column(3))):
                count = len(data) - length + 1
                digests = b"".join(xxhash.xxh3_128_digest(data[i:i + length]) for i in range(count))
                one, two = np.frombuffer(digests, "<i8").reshape(-1, 2).T
                columns = np.full(count, row_g), np.full(count, row_fp), np.arange(count) + base, one, two
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["g", "fp", "start", "one", "two"])

    rows = written(pieces.select("g", "fp", "base", "data").mapInArrow(
        windows, "g bigint, fp bigint, start bigint, one bigint, two bigint"), "windows")
    often = rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return rows.join(often, ["one", "two"]).groupBy("g", "fp").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("ends"))


def _merged_spans(ends: np.ndarray, length: int) -> bytes:
    """Spans of a document from first and last starts of its stretches: sorted, disjoint, maximal; pairs of 64-bit integers."""
    pairs = ends.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1]) + length
    cut = np.nonzero(pairs[1:, 0] > reach[:-1])[0]
    first, last = pairs[np.append(0, cut + 1), 0], reach[np.append(cut, len(pairs) - 1)]
    return np.column_stack([first, last]).astype(np.int64).tobytes()


def spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """(k, n, spans) of every document that loses bytes, for documents with the keys of ``_keys``."""
    with small_batches(docs.sparkSession):
        return _spans(docs, length)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    every = written(_runs_of(docs, length), "runs")
    seen = every.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # a table of its own, so that the join below can split a hash with very many runs
    seen = written(seen.where("times > 1").select("g", (F.col("lo") == F.col("hi")).alias("alike")), "seen")
    shared = written(every.join(seen, "g"), "shared")
    mixed = shared.where("not alike")
    one = mixed.groupBy("g", "fp").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "n", "p", "w")).alias("x"))
    one = written(one.select("g", "fp", "c", "x.*"), "distinct")
    starts = written(_repeated_starts(written(_fetched(docs, one, length), "contents"), length), "starts")
    # a run with a copy repeats as a whole, as do all runs of a hash that are alike
    times = one.where("c > 1").select("g", "fp")
    whole = shared.where("alike").select("k", "n", "p", "w").union(
        mixed.select("k", "n", "p", "w", "g", "fp").join(times, ["g", "fp"]).select("k", "n", "p", "w"))
    whole = whole.select("k", "n", F.array("p", F.col("p") + F.col("w") - 1).alias("ends"))
    single = one.where("c = 1").join(starts, ["g", "fp"]).select(
        "k", "n", F.transform("ends", lambda e: e + F.col("p")).alias("ends"))
    grouped = whole.union(single).groupBy("k", "n").agg(F.flatten(F.collect_list("ends")).alias("ends"))

    def merged(batches):
        for batch in batches:
            lists = batch.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            cuts = [_merged_spans(values[a:b], length) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.binary())], ["k", "n", "spans"])

    return written(grouped.mapInArrow(merged, "k bigint, n bigint, spans binary"), "spans")


def _kept(data: bytes, cut: bytes | None) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, spans)."""
    if not cut:
        return data, 0, 0
    pairs = np.frombuffer(cut, np.int64).reshape(-1, 2)
    out, at = [], 0
    for first, last in pairs.tolist():
        out.append(data[at:first])
        at = last
    out.append(data[at:])
    return b"".join(out), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs)


def _with_spans(docs: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    found = spans(keyed, length=length)
    rows, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("spans"))).first()
    return docs.join(F.broadcast(found) if rows * 64 + (size or 0) <= BROADCAST_BYTES else found, ["k", "n"], "left")


def repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, null the empty text. A byte goes if a string of ``length`` bytes that
    covers it starts anywhere else too, in the same text or another row; strings are judged on
    the input. Matches do not cross texts; texts below ``length`` bytes stay. Repeated rows are
    copies of each other. The hash is that of the remaining bytes. Other columns are ignored.
    """
    keyed = _keys(docs)

    def run(batches):
        for batch in batches:
            rows = []
            for data, cut in zip(each_utf8(batch.column(1)), batch.column(2)):
                rest, gone, count = _kept(data, cut.as_py())
                rows.append((len(data), gone, count, hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*rows)) or [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_spans(keyed, keyed, length).select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``docs`` with shortened texts; columns as they came, ``n_chars`` counted again where it is one.

    Where a cut leaves part of a letter's bytes, that part goes too. Null texts stay null.
    """
    @F.arrow_udf("string")
    def rest(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array((t.as_py() if t.as_buffer() is None or not c.is_valid else
                         _kept(t.as_buffer().to_pybytes(), c.as_py())[0].decode(errors="ignore")
                         for t, c in zip(texts, cuts)), pa.string())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k, n, cut = spare(docs, "text_key"), spare(docs, "text_bytes"), spare(docs, "cut_spans")
    keyed = docs.withColumns({k: F.xxhash64("doc_id", text), n: F.octet_length(text).cast("long")})
    found = spans(_keys(docs), length=length)
    rows, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("spans"))).first()
    found = found.withColumnsRenamed({"k": k, "n": n, "spans": cut})
    joined = keyed.join(F.broadcast(found) if rows * 64 + (size or 0) <= BROADCAST_BYTES else found, [k, n], "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    short = joined.where(F.col(cut).isNotNull()).withColumn("text", rest("text", cut))
    if "n_chars" in docs.columns:
        short = short.withColumn("n_chars", F.length("text").cast("long"))
    # only texts that lose something go to Python, in small batches, which hold while a job runs
    with small_batches(docs.sparkSession):
        short = written(short.select(*names), "short")
    return joined.where(F.col(cut).isNull()).select(*names).unionByName(short)
