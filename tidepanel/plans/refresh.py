"""Which keys need work: eligibility, history, freshness and the incremental run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel import settings as S
from tidepanel.functions.dates import business_horizon, is_stale, snapshot_stale
from tidepanel.plans.arima import work_grid

KEY = ["symbol", "model", "steps"]


def last_close(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(
        F.max_by("close", "date").alias("last_close"), F.max("date").alias("last_date"))


def eligible_tasks(prices: DataFrame, threshold: float = 1.0, models=None, steps=None) -> DataFrame:
    """symbol, model, steps: every (model, horizon) of the series whose last close is above ``threshold``."""
    chosen = last_close(prices).where(F.col("last_close") > threshold).select("symbol")
    return work_grid(chosen, models or S.MODELS, steps or list(S.HORIZON_BDAYS))


def history_check(prices: DataFrame, steps: list[int]) -> DataFrame:
    """Rows per series against the need of each horizon: max(70, h + 10), and more
    than h for a backtest. Rejected keys stay in the result with their reason."""
    sizes = prices.groupBy("symbol").agg(F.count("close").alias("n"))
    rows = sizes.withColumn("steps", F.explode(F.array(*[F.lit(s) for s in steps])))
    h = business_horizon("steps")
    reason = F.when(F.col("n") <= h, "series too short for the backtest window").when(
        F.col("n") < F.greatest(F.lit(70), h + 10), "not enough data")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def missing_forecasts(grid: DataFrame, runs: DataFrame) -> DataFrame:
    return grid.join(runs.select(*KEY).distinct(), KEY, "left_anti")


def stale_runs(runs: DataFrame, as_of, cutoff=S.FORECAST_CUTOFF) -> DataFrame:
    """Stored runs made before the last daily cutoff."""
    return runs.where(is_stale("updated_at", as_of, *cutoff))


def stale_snapshots(stocks: DataFrame, as_of) -> DataFrame:
    """Snapshots whose last update lies on an earlier local day."""
    return stocks.where(snapshot_stale("last_updated", as_of))


def news_to_fetch(symbols: DataFrame, news: DataFrame, as_of, cutoff=S.NEWS_CUTOFF) -> DataFrame:
    """Symbols whose news list is missing or was stored before the last daily news cutoff."""
    fresh = news.groupBy("symbol").agg(F.max("updated_at").alias("updated_at")).where(
        ~is_stale("updated_at", as_of, *cutoff))
    return symbols.select("symbol").distinct().join(fresh, "symbol", "left_anti")


def refresh_plan(grid: DataFrame, runs: DataFrame, as_of, cutoff=S.FORECAST_CUTOFF) -> DataFrame:
    """Keys to compute: not stored, or stored before the last cutoff."""
    fresh = runs.where(~is_stale("updated_at", as_of, *cutoff)).select(*KEY)
    return grid.select(*KEY).join(fresh, KEY, "left_anti")


def run_rows(fits: DataFrame, as_of) -> DataFrame:
    """Stored form of fits: one row per key with its backtest error; none for a key with a failed part.

    The error is computed from the held-out rows each fit carries, so no join is
    needed.
    """
    err = F.aggregate(
        F.zip_with("path", "test", lambda p, t: F.abs(p - t["actual"])), F.lit(0.0),
        lambda s, x: s + x) / F.size("path")
    return fits.groupBy(*KEY).agg(
        F.max(F.when(F.col("kind") == "backtest", err)).alias("backtest_mae"),
        F.max(F.when(F.col("kind") == "future", F.col("last_price"))).alias("last_price"),
        F.max(F.col("status") != "ok").alias("_failed"),
    ).where("not _failed").drop("_failed").withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz"))


def rejected_rows(checked: DataFrame, todo: DataFrame) -> DataFrame:
    """Status of open keys whose series is too short, with the reason."""
    short = checked.where(~F.col("accepted")).select("symbol", "steps", F.col("reason").alias("error"))
    return todo.join(short, ["symbol", "steps"]).select(*KEY, F.lit("error").alias("status"), "error")


def status_rows(fits: DataFrame) -> DataFrame:
    """ok / error per key: one failed part marks the key."""
    return fits.groupBy(*KEY).agg(
        F.when(F.max((F.col("status") != "ok").cast("int")) == 1, "error").otherwise("ok").alias("status"),
        F.first("error", ignorenulls=True).alias("error"))
