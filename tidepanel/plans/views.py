"""Tables behind the pages: snapshot, heat map, dashboard, analytics and forecast views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel import settings as S
from tidepanel.functions import scalars as X
from tidepanel.functions.dates import market_open, to_zone
from tidepanel.operators.rolling import (downsample, downsample_step, last_rows, moving_averages,
                                         numbered, pct_change, trailing)
from tidepanel.plans.evaluate import mae_pct


def live_snapshot(bars: DataFrame, fundamentals: DataFrame, as_of=None, *, keys=("symbol",)) -> DataFrame:
    """Last price, change against the previous close (or the first open), colour and cap.

    The bars are reduced by max_by / min_by, which combine map-side, before the join.
    """
    ends = bars.groupBy(*keys).agg(
        F.max_by("close", "ts").alias("close"), F.min_by("open", "ts").alias("open"),
        F.max("ts").alias("last_ts"))
    return snapshot_rows(ends, fundamentals, as_of)


def snapshot_rows(ends: DataFrame, fundamentals: DataFrame, as_of=None) -> DataFrame:
    facts = fundamentals.select("symbol", "prev_close", "market_cap")
    base = F.coalesce(X.present("prev_close"), F.col("open"))
    pct = X.change_pct("close", base)
    stamp = F.col("last_ts") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    return ends.join(facts, "symbol", "left").withColumn("_pct", pct).select(
        "symbol",
        F.round("close", 2).alias("price"),
        F.round("_pct", 2).alias("change"),
        X.present("market_cap").cast("long").alias("market_cap"),
        X.change_colour("_pct").alias("bg_color"),
        stamp.alias("last_updated"),
    )


def bars_of_day(bars: DataFrame, as_of) -> DataFrame:
    """Bars of the New York day of ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return bars.where(to_zone("ts", S.MARKET_TZ).cast("date") == to_zone(now, S.MARKET_TZ).cast("date"))


def preview(df: DataFrame, rows: int = 10, newest: bool = True) -> DataFrame:
    """A few rows from the end (or start) by date; a top-k, not a sort of the table."""
    day = F.col("date").desc() if newest else F.col("date")
    return df.orderBy(day, "symbol").limit(rows)


def in_market_hours(bars: DataFrame, force: bool = False) -> DataFrame:
    return bars.where(market_open("ts", force))


def heat_map(stocks: DataFrame) -> DataFrame:
    """Largest market cap first; rows without one at the end."""
    return stocks.orderBy(F.col("market_cap").desc_nulls_last(), "symbol")


def last_update(stocks: DataFrame) -> DataFrame:
    """Newest update in local time."""
    newest = F.date_trunc("second", to_zone(F.max("last_updated"), S.LOCAL_TZ)).cast("timestamp_ntz")
    return stocks.agg(F.date_format(newest, "HH:mm:ss yyyy-MM-dd").alias("last_updated"))


def fundamentals_table(fundamentals: DataFrame) -> DataFrame:
    """0 for missing values, two decimals; cap in billions."""
    two = ["dividend_yield", "trailing_pe", "beta", "price_to_book"]
    return fundamentals.select(
        "symbol", *[X.shown(c).alias(c) for c in two],
        F.round(F.coalesce("avg_volume", F.lit(0.0))).cast("long").alias("avg_volume"),
        X.billions("market_cap").alias("market_cap_bn"))


def with_exchange(df: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    return df.withColumn("exchange", X.map_lookup(
        "symbol", S.EXCHANGES if table is None else table, S.DEFAULT_EXCHANGE))


def financials_trend(statements: DataFrame) -> DataFrame:
    """Rows with a positive revenue or net income, by date."""
    return statements.where((F.col("revenue") > 0) | (F.col("net_income") > 0)).orderBy(
        "symbol", "date")


def high_low(prices: DataFrame, volume: str | None = None) -> DataFrame:
    """52-week high and low from the last date back; mean volume where there is one."""
    end = F.max("date").over(W.partitionBy("symbol"))
    recent = prices.withColumn("_end", end).where(F.col("date") > F.add_months("_end", -12))
    more = [F.round(F.avg(volume)).cast("long").alias("avg_volume")] if volume else []
    return recent.groupBy("symbol").agg(
        F.round(F.max("close"), 2).alias("high_52w"), F.round(F.min("close"), 2).alias("low_52w"), *more)


def ytd_change(prices: DataFrame, as_of) -> DataFrame:
    """Change since the first close of the year in percent; 0 without a close."""
    day = F.lit(as_of).cast("date")
    this_year = F.col("date") >= F.trunc(day, "year")
    return prices.groupBy("symbol").agg(
        F.round(F.coalesce(X.change_pct(
            F.max_by(F.when(this_year, F.col("close")), F.when(this_year, F.col("date"))),
            F.min_by(F.when(this_year, F.col("close")), F.when(this_year, F.col("date")))),
            F.lit(0.0)), 2).alias("ytd_pct"))


def analytics_history(panel: DataFrame) -> DataFrame:
    return moving_averages(panel).select(
        "symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "close", "ma50", "ma200")


def dividend_history(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Hypothetical dividend per day: close times the current yield."""
    rate = fundamentals.select("symbol", X.shown("dividend_yield").alias("yield_pct"))
    return panel.join(rate, "symbol", "left").select(
        "symbol", "date",
        (F.col("close") * F.coalesce("yield_pct", F.lit(0.0)) / 100).alias("dividend"))


def chart_history(panel: DataFrame, steps: int, rows: int = 300) -> DataFrame:
    """At most the last ``rows`` rows, thinned for long horizons."""
    return downsample(last_rows(panel, rows), downsample_step(F.lit(steps)))


def chart_points(points: DataFrame) -> DataFrame:
    """Forecast points thinned by their horizon: each k-th step and the last."""
    keys = W.partitionBy("symbol", "model", "steps", "kind")
    last = F.max("step").over(keys)
    every = downsample_step("steps")
    return (
        points.withColumn("_last", last)
        .where(((F.col("step") - 1) % every == 0) | (F.col("step") == F.col("_last")))
        .drop("_last"))


def chart_frame(history: DataFrame, points: DataFrame, models: list[str]) -> DataFrame:
    """One row per chart day: historical price, then one column per model."""
    past = history.select("symbol", "date", F.lit("historical").alias("series"),
                          F.col("close").alias("price"))
    ahead = points.select("symbol", "date", F.col("model").alias("series"), "price")
    return past.unionByName(ahead).groupBy("symbol", "date").pivot(
        "series", ["historical", *models]).agg(F.first("price"))


def pairs_json(df: DataFrame, keys: list[str], day: str = "date", price: str = "close") -> DataFrame:
    """Nested chart pairs as JSON text; meant for series that are already thinned."""
    return df.groupBy(*keys).agg(F.to_json(X.price_pairs(day, price)).alias("pairs"))


def forecast_view(panel: DataFrame, runs: DataFrame, points: DataFrame, symbol: str, model: str,
                  steps: int) -> DataFrame:
    """Rows of the forecast page of one key: history, backtest and forecast."""
    one = (F.col("symbol") == symbol) & (F.col("model") == model) & (F.col("steps") == steps)
    history = chart_history(panel.where(F.col("symbol") == symbol), steps).select(
        "symbol", "date", F.lit("historical").alias("kind"), F.round("close", 2).alias("price"))
    shown = chart_points(points.where(one)).select(
        "symbol", "date", "kind", F.round("price", 2).alias("price"))
    facts = runs.where(one).select(
        "symbol", "backtest_mae", "last_price",
        mae_pct("backtest_mae", "last_price").alias("backtest_mae_pct"))
    return history.unionByName(shown).join(facts, "symbol", "left")


def market_snapshot(panel: DataFrame) -> DataFrame:
    """Latest state per series: close, moving averages, volatility, range and change.

    The newest row of each series carries its trailing statistics; the year range
    is a trailing window over the same partitioning.
    """
    rows = numbered(panel)
    rows = rows.withColumn("ret", pct_change("close")).withColumns({
        "ma50": trailing(F.avg, "close", 50),
        "ma200": trailing(F.avg, "close", 200),
        "vol_pct": trailing(F.stddev_samp, "ret", 20) * 100,
        "high_252": trailing(F.max, "close", 252, min_rows=1),
        "low_252": trailing(F.min, "close", 252, min_rows=1),
        "first_close": F.first("close").over(W.partitionBy("symbol").orderBy("date")),
    })
    return rows.where(F.col("rn") == F.col("n")).select(
        "symbol", "date", "close", "ret", "ma50", "ma200", "vol_pct", "high_252", "low_252",
        X.change_pct("close", "first_close").alias("change_pct"))
