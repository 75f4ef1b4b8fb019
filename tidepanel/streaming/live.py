"""Structured Streaming jobs: bars to snapshots, articles to news, prices to daily sums and to the keys to refresh.

Every job runs over a folder of files with ``availableNow`` or a processing-time
trigger. Micro-batches are stored under their batch id, so a batch that is run
again after a lost executor or driver leaves the table as it was.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidepanel import settings as S
from tidepanel.functions.dates import market_open, to_zone, utc_instant
from tidepanel.operators.calendar import in_cents
from tidepanel.plans import news as news_plans, refresh
from tidepanel.plans.views import snapshot_rows
from tidepanel.sources.merge import BatchLog, BucketTable, latest_per_key

WATERMARK = "2 days"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                pattern: str | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def day_ends(bars: DataFrame, *, force: bool = False, watermark: str = WATERMARK) -> DataFrame:
    """First open and last close per symbol and UTC day (a New York session never crosses one); works on a stream and on
    a table. State is one small row per symbol and day, dropped after the watermark."""
    rows = bars.where(market_open("ts", force)).withColumn("_at", utc_instant("ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", watermark)
    day = F.window("_at", "1 day")
    ends = rows.groupBy("symbol", day.alias("day")).agg(
        F.max_by("close", "ts").alias("close"), F.min_by("open", "ts").alias("open"),
        F.max("ts").alias("last_ts"))
    return ends.select("symbol", F.col("day.start").alias("day"), "close", "open", "last_ts")


def query_id(spark, checkpoint: str) -> str:
    """Id of the query that owns a checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _start(stream: DataFrame, write, checkpoint: str, mode: str, trigger: dict):
    return (stream.writeStream.foreachBatch(write).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def live_job(bars: DataFrame, fundamentals: DataFrame, table: BucketTable, checkpoint: str,
             *, force: bool = False, trigger: dict | None = None):
    """Bars -> newest snapshot per symbol in ``table`` (STOCKS by symbol, the latest ``last_updated`` counts)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("symbol").agg(
            F.max_by(F.struct("close", "open", "last_ts"), "day").alias("r")).select("symbol", "r.*")
        table.write(snapshot_rows(newest, fundamentals), batch_id, query_id(batch.sparkSession, checkpoint))

    return _start(day_ends(bars, force=force), write, checkpoint, "update",
                  trigger or {"availableNow": True})


def news_job(articles: DataFrame, aliases: dict[str, str], log: BatchLog, checkpoint: str,
             as_of: str, *, trigger: dict | None = None):
    """Articles -> relevant news, appended to ``log`` (NEWS).

    The query keeps no state and drops no late article: ``stored_news`` reads one row per
    symbol and address, however often and whenever it was delivered.
    """
    matched = news_plans.relevant(articles, aliases).withColumn(
        "updated_at", F.lit(as_of).cast("timestamp_ntz"))

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, batch_id, query_id(batch.sparkSession, checkpoint))

    return _start(matched, write, checkpoint, "append", trigger or {"availableNow": True})


def stored_news(log: BatchLog) -> DataFrame:
    """One row per symbol and address, the newest delivery."""
    return latest_per_key(log.read(), ["symbol", "url"]).drop("run", "batch")


def price_job(raw: DataFrame, log: BatchLog, checkpoint: str, *, key: str, ts: str,
              value: str, trigger: dict | None = None):
    """Raw prices -> cents and counts per (symbol, day) and batch, the input of the
    nightly refresh.

    The query keeps no state: each batch is folded on its own (map-side first), and
    the exact sums of a day add up when the log is read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        cents = in_cents(value)
        log.write(batch.where(F.col(value).isNotNull()).groupBy(
            F.col(key).cast("string").alias("symbol"), F.col(ts).cast("date").alias("date")).agg(
            F.sum(cents).alias("cents"), F.count(cents).alias("n")), batch_id,
            query_id(batch.sparkSession, checkpoint))

    return _start(raw, write, checkpoint, "append", trigger or {"availableNow": True})


def cutoff_prices(raw: DataFrame, *, key: str, ts: str, value: str, cutoff: tuple[int, int] = S.FORECAST_CUTOFF,
                  zone: str = S.LOCAL_TZ, watermark: str = WATERMARK) -> DataFrame:
    """Last price of each symbol between two daily cutoffs: (symbol, close, last_ts, cutoff), times in UTC.

    Event time is the wall clock of ``zone``, so a window ends at the cutoff on every day. On a stream the state is one
    row per symbol and open window; it is emitted once, when the watermark has passed the cutoff, and dropped.
    """
    local = to_zone(F.col(ts).cast("timestamp_ntz"), zone)
    rows = raw.where(F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias("symbol"), F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(value).cast("double").alias("close"), utc_instant(local).alias("_at"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", watermark)
    window = F.window("_at", "1 day", startTime=f"{cutoff[0]} hours {cutoff[1]} minutes")
    ends = rows.groupBy("symbol", window.alias("w")).agg(F.max_by("close", "ts").alias("close"), F.max("ts").alias("last_ts"))
    wall = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_seconds(F.col("w.end")))
    return ends.select("symbol", "close", "last_ts", F.convert_timezone(F.lit(zone), F.lit("UTC"), wall).alias("cutoff"))


def refresh_job(raw: DataFrame, prices: BucketTable, runs: BucketTable, todo: BucketTable, checkpoint: str, *, key: str,
                ts: str, value: str, models: list[str] | None = None, steps: list[int] | None = None,
                threshold: float = 1.0, trigger: dict | None = None):
    """Raw prices -> the keys to compute after each cutoff, in ``todo`` (TODO), as input of the nightly run.

    ``prices`` (LAST_PRICES) keeps the last price of every symbol seen so far. When a cutoff closes, the plan of that
    cutoff is made from it and the stored ``runs``, once: a batch that closes nothing new writes nothing, and
    one that is repeated takes its own place.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        run = query_id(batch.sparkSession, checkpoint)
        prices.write(batch, batch_id, run)
        last = prices.read()
        newest = last.agg(F.max("cutoff")).first()[0]
        planned = todo.read().agg(F.max("cutoff")).first()[0]
        if newest is None or planned is not None and newest <= planned:
            return
        as_of = F.lit(newest).cast("timestamp_ntz")
        grid = refresh.eligible_tasks(last.withColumnRenamed("last_ts", "date"), threshold, models, steps)
        todo.write(refresh.refresh_plan(grid, runs.read(), as_of).withColumn("cutoff", as_of), batch_id, run)

    ends = cutoff_prices(raw, key=key, ts=ts, value=value)
    return _start(ends, write, checkpoint, "append", trigger or {"availableNow": True})


def due(todo: BucketTable, runs: BucketTable) -> DataFrame:
    """Planned keys that have not been computed since their cutoff."""
    done = runs.read().select(*refresh.KEY, "updated_at")
    return todo.read().join(done, refresh.KEY, "left").where(
        F.col("updated_at").isNull() | (F.col("updated_at") < F.col("cutoff"))).select(*refresh.KEY)


def daily_prices(log: BatchLog) -> DataFrame:
    return log.read().groupBy("symbol", "date").agg(
        (F.sum("cents") / F.sum("n") / 100).alias("close"))


LAST_PRICES = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("close", T.DoubleType()),
    T.StructField("last_ts", T.TimestampNTZType()), T.StructField("cutoff", T.TimestampNTZType())])
TODO = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("steps", T.IntegerType()), T.StructField("cutoff", T.TimestampNTZType())])
DAILY_SUMS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("cents", T.LongType()), T.StructField("n", T.LongType())])
