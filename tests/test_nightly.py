import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import job
from tidepanel.operators import calendar as cal
from tidepanel.plans import nightly
from tidepanel.sources import readers, schemas
from tidepanel.sources.merge import BucketTable


def _walk(seed, n=330):
    return list(100 + np.random.default_rng(seed).normal(size=n).cumsum())


def _tables(spark, root):
    key = nightly.POINT_KEY
    return (BucketTable(spark, f"{root}/runs", schemas.FORECAST_RUNS, key),
            BucketTable(spark, f"{root}/points", schemas.FORECAST_POINTS, key, order=None))


def test_unknown_model(weekdays):
    with pytest.raises(ValueError, match="Unknown model"):
        nightly.forecast(weekdays({"A": [1.0]}), ["prophet"], [7])


def test_registered_model(weekdays):
    nightly.register("flat", lambda market, steps, models, **o: nightly._drift(market, steps, models))
    try:
        assert nightly.forecast(weekdays({"A": _walk(1, 30)}), ["flat"], [7]).count() == 2
    finally:
        del nightly.REGISTRY["flat"]


def test_nightly_computes_only_open_keys(spark, weekdays, tmp_path):
    market = weekdays({"AEP": _walk(1), "DUK": _walk(2), "penny": [0.5] * 330})
    market = market.withColumn("oil", F.sin(F.unix_date("date") / 7.0))
    runs, points = _tables(spark, tmp_path)
    first = nightly.nightly(market, runs, points, "2024-01-10 13:00:00",
                            models=["arima", "sarimax"], steps=[7])
    assert {(r["symbol"], r["model"], r["status"]) for r in first.collect()} == {
        (s, m, "ok") for s in ("AEP", "DUK") for m in ("arima", "sarimax")}
    # later the same evening only the new model is open
    second = nightly.nightly(market, runs, points, "2024-01-10 20:00:00",
                             models=["arima", "sarimax", "lstm"], steps=[7], lookback=20)
    assert {(r["symbol"], r["model"]) for r in second.collect()} == {("AEP", "lstm"), ("DUK", "lstm")}
    assert runs.read().count() == 6
    per_key = points.read().groupBy("symbol", "model", "steps", "kind").count().collect()
    assert len(per_key) == 12 and {r["count"] for r in per_key} == {5}
    # after the next cutoff everything is stale again
    third = nightly.nightly(market, runs, points, "2024-01-11 12:30:00", models=["arima"], steps=[7])
    assert third.count() == 2 and runs.read().count() == 6
    newest = {r["model"]: r["t"] for r in runs.read().groupBy("model").agg(
        F.max("updated_at").alias("t")).collect()}
    assert newest["arima"] == dt.datetime(2024, 1, 11, 12, 30)
    assert newest["sarimax"] == dt.datetime(2024, 1, 10, 13, 0)


def test_history_rule_slices_the_series(weekdays):
    fits = nightly.forecast_by_period(weekdays({"A": _walk(3, 900)}), ["arima"], [7, 180])
    got = {(r["steps"], r["kind"]): r["n_train"] for r in fits.collect()}
    assert got[(7, "future")] < 135 and 500 < got[(180, "future")] < 530


def test_names():
    assert job.names("AEP, DUK  SO") == ["AEP", "DUK", "SO"]


def test_one_per_day(make_prices):
    df = make_prices({"A": [("2024-01-02", 1), ("2024-01-02", 3), ("2024-01-03", 2)]})
    assert sorted(r["close"] for r in cal.one_per_day(df).collect()) == [2.0, 3.0]


def test_command_line(spark, weekdays, tmp_path):
    prices = weekdays({"AEP": _walk(5, 200), "ZZZ": _walk(6, 200)}).withColumnRenamed("close", "Close")
    prices.write.csv(str(tmp_path / "prices"), header=True)
    weekdays({"CL=F": _walk(7, 200)}).withColumnsRenamed({"symbol": "code", "close": "value"}).write.csv(
        str(tmp_path / "exog"), header=True)
    job.main(["ingest", "--prices", str(tmp_path / "prices"), "--exog-path", str(tmp_path / "exog"),
              "--out", str(tmp_path / "out"), "--tickers", "aep", "--exog", "CL=F", "--format", "csv"])
    stored = readers.read_market(spark, str(tmp_path / "out" / "market.parquet"))
    assert set(stored.columns) == {"date", "symbol", "close", "cl_f"} and stored.count() == 200
    assert stored.where("cl_f = 0").count() == 0
    job.main(["forecast", "--market", str(tmp_path / "out" / "market.parquet"), "--tables",
              str(tmp_path / "t"), "--as-of", "2024-12-01 13:00:00", "--models", "arima sarimax", "--steps", "7"])
    runs = BucketTable(spark, str(tmp_path / "t" / "forecast_runs"), schemas.FORECAST_RUNS, nightly.POINT_KEY)
    assert runs.read().count() == 2


def test_short_series_are_reported_and_stay_open(spark, weekdays, tmp_path):
    market = weekdays({"AEP": _walk(1), "new": _walk(2, 60)})
    runs, points = _tables(spark, tmp_path)
    status = nightly.nightly(market, runs, points, "2024-01-10 13:00:00", models=["arima"], steps=[7])
    assert {r["symbol"]: (r["status"], r["error"]) for r in status.collect()} == {
        "AEP": ("ok", None), "new": ("error", "not enough data")}
    assert {r["symbol"] for r in runs.read().collect()} == {"AEP"} == {r["symbol"] for r in points.read().collect()}
    planned = spark.createDataFrame([("AEP", "arima", 7), ("AEP", "arima", 180)], "symbol string, model string, steps int")
    redone = nightly.nightly(market, runs, points, "2024-01-10 13:30:00", models=["arima"], steps=[7], keys=planned)
    assert [(r["symbol"], r["steps"]) for r in redone.collect()] == [("AEP", 7)]
    again = nightly.nightly(market, runs, points, "2024-01-10 14:00:00", models=["arima"], steps=[7])
    assert [(r["symbol"], r["status"]) for r in again.collect()] == [("new", "error")]
