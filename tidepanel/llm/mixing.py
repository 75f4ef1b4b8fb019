"""Mixing sources to target weights with a low-discrepancy schedule of equal blocks of words.

* Targets: sources in code-point order weigh 1, 2, 3, 1, 2, 3, ... and share the words of all
  documents; no target is above EPOCHS times the words of its source, the excess goes to the
  others by weight.
* Schedule: slot ``s`` has the point frac(s * golden ratio); cumulative shares map it to a
  source, and its rank among the slots of that source to a block of that source.
* Blocks: the documents of a source, in the order of a hash, are one stream of words, cut every
  ``block_words`` words. Slot ranks go through the blocks again and again.

Everything is DataFrame expressions. Running sums are taken inside buckets of about
BUCKET_ROWS documents, and bucket offsets are added, so a source with a third of all rows is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import spare
from tidepanel.session import written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
EPOCHS = 3
BLOCK_WORDS = 1024
BUCKET_ROWS = 4096
SLOT_CHUNK = 1 << 16
BINS = 4096  # parts of the unit interval used to find a point's source by an equality join
GOLDEN = 0.6180339887498949  # fractional part of the golden ratio
_HIGH = 1 << 20  # a slot number is split here, so that its product keeps its fraction
BROADCAST_ROWS = 1_000_000  # rows of three numbers


def _golden_high() -> float:
    """Fraction of 2**20 times the golden ratio, from integers (isqrt), exact to 53 bits."""
    from math import isqrt

    scale = 1 << 80
    golden = (isqrt(5 * scale * scale) - scale) // 2  # fraction * 2**80
    return (golden * _HIGH % scale) / scale


_GOLDEN_HIGH = _golden_high()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, total): also weight, target and a number ``s`` per source.

    The level at which weights fill the caps is found in one pass: sources are ordered by
    cap / weight; the first whose fair level, after all before it are full, is within its cap
    sets the level of the rest. One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    capped = (sizes.withColumn("s", F.row_number().over(by_name)).withColumn("weight", weight)
              .withColumn("cap", F.col("total").cast("double") * EPOCHS)
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    rising = Window.orderBy("ratio", "s")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = ((F.sum(F.col("total").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    return (capped.withColumn("level", level)
            .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s", "level"))).over(every)["level"])
            .select("source", "s", "total", "weight",
                    F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target")))


def _plan(sized: DataFrame, block_words: int) -> DataFrame:
    """Per source: its share [lo, hi) of the unit interval, number of documents, blocks and slots."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("docs"))
    goal = targets(sizes.select("source", "total"))
    to_here = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("target").over(Window.partitionBy())
    words, each = F.floor("target"), F.greatest("total", F.lit(1))
    rest = words % each
    epochs = F.floor((words - rest) / each)
    return (goal.join(sizes.select("source", "docs").withColumnRenamed("source", "name"),
                      F.col("source").eqNullSafe(F.col("name"))).drop("name")
            .withColumn("hi", F.when(whole > 0, F.sum("target").over(to_here) / whole).otherwise(0.0))
            .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("s")), F.lit(0.0)))
            .withColumn("blocks", F.ceil(F.col("total") / block_words))
            .withColumn("rest", F.when(F.col("total") > 0, rest).otherwise(0))
            .withColumn("slots", F.when(F.col("total") > 0, epochs * F.col("blocks") + F.ceil(rest / block_words))
                        .otherwise(0)))


def _slots(plan: DataFrame, block_words: int) -> DataFrame:
    """(s, rank, slot) of the schedule: exactly ``slots`` ranks of every source.

    Points give every source its slots up to a few; ranks beyond ``slots`` are left out and
    missing ranks come at the end.
    """
    spark = plan.sparkSession
    count = plan.agg(F.sum("slots")).first()[0] or 0
    high, low = F.floor(F.col("id") / _HIGH), F.col("id") % _HIGH
    point = high * F.lit(_GOLDEN_HIGH) - F.floor(high * F.lit(_GOLDEN_HIGH)) + low * F.lit(GOLDEN)
    points = (spark.range(count).withColumn("point", point - F.floor(point))
              .withColumn("bin", F.floor(F.col("point") * BINS)))
    parts = plan.where("hi > lo").select(
        "s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS),
                                              F.least(F.floor(F.col("hi") * BINS), F.lit(BINS)))).alias("bin"))
    owned = (points.join(parts, "bin").where("point >= lo and point < hi")
             .select("id", "s", F.floor(F.col("id") / SLOT_CHUNK).alias("chunk")))
    owned = written(owned, "slots")
    counts = owned.groupBy("s", "chunk").count()
    earlier = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("s", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("s", "chunk").orderBy("id")
    ranked = (owned.withColumn("n", F.row_number().over(inside)).join(starts, ["s", "chunk"])
              .select("s", (F.col("first") + F.col("n") - 1).alias("rank"), F.col("id").alias("slot")))
    found = owned.groupBy("s").agg(F.count(F.lit(1)).alias("found"))
    missing = (plan.select("s", "slots").join(found, "s", "left")
               .withColumn("found", F.coalesce("found", F.lit(0))).where("found < slots")
               .select("s", F.explode(F.sequence("found", F.col("slots") - 1)).alias("rank"))
               .withColumn("slot", F.lit(count) + F.col("rank")))
    return (ranked.join(plan.select("s", "slots"), "s").where("rank < slots").select("s", "rank", "slot")
            .union(missing))


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, s, rank, block, words): which block of which source a slot takes, and how many of its words.

    Only the last slot of a source takes less than its block, so that the source meets its target.
    """
    rows = _slots(plan, block_words).join(plan.select("s", "total", "blocks", "slots", "rest"), "s")
    block = F.col("rank") % F.col("blocks")
    whole = F.least(F.lit(block_words), F.col("total") - block * block_words)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return rows.select("slot", "s", "rank", block.alias("block"),
                       F.when(last, F.col("rest") - block * block_words).otherwise(whole).alias("words"),
                       whole.alias("block_size"))


def _placed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the place of their first word in the stream of their source."""
    small = plan.select(F.col("source").alias("name"), "s", "docs", "total", "target")
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(4)), 1)
    rows = (sized.join(small, F.col("source").eqNullSafe(F.col("name"))).drop("name")
            .withColumn("h", order)
            .withColumn("bucket", F.floor(F.col("h") / F.lit(2.0**63) * F.ceil(F.col("docs") / BUCKET_ROWS))))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("s", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["s", "bucket"])
            .withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
            .select("doc_id", "size", "s", "total", "target", "start"))


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    ``size`` counts the words of the text (null and empty: 0), ``source_size`` those of the
    source, ``target`` the words asked of the source, ``taken`` the words of this row that the
    mix takes, repeats counted; never more than EPOCHS times ``size``. A null source is a
    source, the last. Sources without words have target 0. Rows that share a doc_id are mixed
    row by row; identical rows may differ in ``taken`` but not from run to run. Other columns
    are ignored. A source takes floor(target) words.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    plan = written(_plan(sized, block_words), "plan")
    slots = schedule(plan, block_words)
    short = F.col("words") < F.col("block_size")
    blocks = slots.groupBy("s", "block").agg(
        F.sum(F.when(short, 0).otherwise(1)).alias("times"), F.max(F.when(short, F.col("words")).otherwise(0)).alias("part"))
    first = F.floor(F.col("start") / block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = _placed(sized, plan).withColumn(
        "block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    begin = F.greatest("start", F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    in_part = F.greatest(F.lit(0), F.least(end, F.col("block") * block_words + F.col("part")) - begin)
    taken = F.when(F.col("times").isNull(), 0).otherwise((end - begin) * F.col("times") + in_part)
    return (pieces.join(blocks, ["s", "block"], "left").withColumn("taken", taken)
            .groupBy("doc_id", "s", "start", "size", F.col("total").alias("source_size"), "target")
            .agg(F.sum("taken").cast("long").alias("taken"), F.count_if(F.col("block") <= 0).alias("rows"))
            .withColumn("rows", F.when(F.col("size") > 0, 1).otherwise(F.col("rows")))
            .select("doc_id", "size", "source_size", "target", "taken",
                    F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row"))


def mixed(docs: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with every document as often as the mix takes it; columns as they came.

    A row comes round(taken / size) times, from 0 to EPOCHS; rows without words stay as they are.
    Rows that share doc_id and size share the mean of their counts.
    """
    times = (mix(docs, block_words=block_words).where("size > 0 and doc_id is not null").groupBy("doc_id", "size")
             .agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("times")).where("times <> 1"))
    times = written(times, "times")
    if times.count() <= BROADCAST_ROWS:
        times = F.broadcast(times)
    size, count, name = spare(docs, "size"), spare(docs, "times"), spare(docs, "mixed_id")
    times = times.select(F.col("doc_id").alias(name), F.col("size").alias("_" + size), F.col("times").alias(count))
    rows = docs.withColumn(size, word_count(F.col("text"))).join(
        times, (F.col("doc_id") == F.col(name)) & (F.col(size) == F.col("_" + size)), "left")
    turns = spare(rows, "turn")
    return (rows.withColumn(turns, F.explode(F.array_repeat(F.lit(1), F.coalesce(F.col(count), F.lit(1)))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
