"""Model registry and the nightly run over all series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidepanel import settings as S
from tidepanel.operators.indicators import indicator_matrix, indicator_names
from tidepanel.operators.market import exog_returns
from tidepanel.operators.rolling import period_slice
from tidepanel.plans import arima, drift, learned, refresh
from tidepanel.session import written
from tidepanel.sources.merge import BucketTable
from tidepanel.sources.readers import exog_columns

POINT_KEY = ["symbol", "model", "steps"]
COMMON = ["symbol", "model", "steps", "kind", "h", "status", "error", "path", "n_train",
          "last_price", "last_date", "test"]


def _regression(market: DataFrame, steps: list[int], models: list[str], **options) -> DataFrame:
    exog = tuple(exog_columns(market)) if "sarimax" in models else ()
    return arima.forecast_all(market, models=models, steps=steps, exog=exog,
                              params=options.get("params", S.TUNED_ORDERS),
                              defaults=options.get("defaults"), grid=options.get("grid"), only=options.get("only"),
                              exog_mode=options.get("exog_mode", "simulated"))


def _learned(market: DataFrame, steps: list[int], models: list[str], **options) -> DataFrame:
    """Returns of the exog columns over the whole look-back, indicators with their latest value."""
    exog = exog_columns(market)
    wide = indicator_matrix(market.select("symbol", "date", "close"))
    if exog:
        moved = exog_returns(market.select("symbol", "date", *exog), exog).select("symbol", "date", *[f"ex_{c}" for c in exog])
        wide = wide.join(moved, ["symbol", "date"], "left").fillna(0.0, [f"ex_{c}" for c in exog])
    return learned.learned_fits(wide, steps, indicator_names(), options.get("lookback", 120), [f"ex_{c}" for c in exog])


def _drift(market: DataFrame, steps: list[int], models: list[str], **options) -> DataFrame:
    return drift.drift_fits(market, steps)


# model name -> builder of fits; models of one builder share one job
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "arima": _regression, "sarima": _regression, "sarimax": _regression,
    "lstm": _learned, "drift": _drift,
}


def register(name: str, builder: Callable[..., DataFrame]) -> None:
    """Add a model: ``builder(market, steps, models, **options)`` returns fits with the
    columns of ``COMMON``."""
    REGISTRY[name] = builder


def forecast(market: DataFrame, models: list[str], steps: list[int], **options) -> DataFrame:
    """Backtest and future fits of the named models for every series of ``market``."""
    unknown = [m for m in models if m not in REGISTRY]
    if unknown:
        raise ValueError(f"Unknown model {unknown[0]}")
    groups: dict[Callable, list[str]] = {}
    for m in models:
        groups.setdefault(REGISTRY[m], []).append(m)
    parts = [build(market, steps, names, **options).select(*COMMON)
             for build, names in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def forecast_by_period(market: DataFrame, models: list[str], steps: list[int], **options) -> DataFrame:
    """As ``forecast``, each (model, horizon) on the look-back period of its rule."""
    groups: dict[tuple[str, int], list[str]] = {}
    for s in steps:
        for m in models:
            period = "10y" if m == "lstm" else (
                "6mo" if s <= 7 else "2y" if s <= 180 else "5y" if s <= 365 else "10y")
            groups.setdefault((period, s), []).append(m)
    out = None
    for (period, s), names in groups.items():
        part = forecast(period_slice(market, period), names, [s], **options)
        out = part if out is None else out.unionByName(part)
    return out


def nightly(market: DataFrame, runs: BucketTable, points: BucketTable, as_of: str, *,
            models: list[str] | None = None, steps: list[int] | None = None,
            threshold: float = 1.0, keys: DataFrame | None = None, **options) -> DataFrame:
    """Refresh what is missing or stale (or ``keys``, such as a stream has planned) and return the status of every computed key.

    Only series with open work are read and only open keys are fitted; those of too short series are reported and
    left out. A key is stored when all its parts are in order, so one with a failed backtest
    stays open. Both tables take the new keys beside what is stored; a repeated run changes nothing.
    """
    models, steps = models or S.MODELS, steps or list(S.HORIZON_BDAYS)
    if keys is None:
        grid = refresh.eligible_tasks(market, threshold, models, steps)
        keys = refresh.refresh_plan(grid, runs.read(), F.lit(as_of).cast("timestamp_ntz"))
    open_keys = keys.select(*POINT_KEY).where(F.col("model").isin(models) & F.col("steps").isin(steps))
    checked = refresh.history_check(market, steps)
    # two small tables (a row per key) that several steps read
    todo = written(open_keys.join(checked.where("accepted").select("symbol", "steps"), ["symbol", "steps"]).select(*POINT_KEY), "todo")
    rejected = written(refresh.rejected_rows(checked, open_keys), "rejected")
    # at most one row per model and horizon
    wanted = {(r[0], r[1]) for r in todo.select("model", "steps").distinct().collect()}
    if not wanted:
        return rejected
    work = market.join(todo.select("symbol").distinct(), "symbol", "left_semi")
    models = [m for m in models if any(m == x for x, _ in wanted)]
    steps = [s for s in steps if any(s == x for _, x in wanted)]
    # the fits feed two tables and the status, and are computed once
    fits = written(forecast(work, models, steps, only=todo, **options).join(todo, POINT_KEY, "left_semi"), "fits")
    done = refresh.run_rows(fits, as_of)
    rows = arima.forecast_points(fits).select(
        *POINT_KEY, "kind", F.col("step").cast("int").alias("step"), "date", "price")
    points.write(rows.join(done.select(*POINT_KEY), POINT_KEY, "left_semi"))
    runs.write(done)
    return refresh.status_rows(fits).unionByName(rejected)
