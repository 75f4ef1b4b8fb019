import datetime as dt

import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from tidepanel import settings as S
from tidepanel.functions import dates as D
from tidepanel.operators import calendar as cal, market


def test_gap_week(make_prices):
    # Thu, Sat (weekend print), Tue
    df = make_prices({"S": [("2024-01-04", 10), ("2024-01-06", 99), ("2024-01-09", 20)]})
    got = values(cal.align_business_days(df), "date", "close")
    assert got == [(dt.date(2024, 1, 4), 10.0), (dt.date(2024, 1, 5), 10.0),
                   (dt.date(2024, 1, 8), 10.0), (dt.date(2024, 1, 9), 20.0)]


def test_weekend_start(make_prices):
    df = make_prices({"S": [("2024-01-06", 5), ("2024-01-09", 7), ("2024-01-11", 8)]})
    ensured = values(cal.ensure_business_days(df), "date", "close")
    assert ensured[0] == (dt.date(2024, 1, 8), None)
    assert ensured[1] == (dt.date(2024, 1, 9), 7.0)
    assert values(cal.align_business_days(df), "close")[0] == 7.0


def test_weekend_end_is_not_carried(make_prices):
    df = make_prices({"S": [("2024-01-04", 1), ("2024-01-06", 50)]})
    assert values(cal.align_business_days(df), "date", "close") == [
        (dt.date(2024, 1, 4), 1.0), (dt.date(2024, 1, 5), 1.0)]


@pytest.mark.parametrize("days,regular", [
    (pd.date_range("2024-01-01", periods=9), True),
    (pd.bdate_range("2024-01-01", periods=9), True),
    (pd.date_range("2024-01-01", periods=5, freq="3D"), True),
    (pd.date_range("2024-01-01", periods=5, freq="MS"), True),
    (pd.date_range("2024-01-31", periods=5, freq="ME"), True),
    (pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-04"]), False),
    (pd.to_datetime(["2024-01-01", "2024-01-02"]), False),
])
def test_regular_series_stay(make_prices, days, regular):
    df = make_prices({"S": [(d.date(), i) for i, d in enumerate(days)]})
    assert (cal.regular_series(df).count() == 1) is regular
    if len(days) >= 3:
        assert (pd.infer_freq(days) is not None) is regular
    if regular:
        assert values(cal.ensure_business_days(df), "date") == [d.date() for d in days]


def test_align_matches_pandas(make_prices):
    import random

    rng = random.Random(3)
    days = sorted(rng.sample(range(400), 90))
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(days=k), rng.random()) for k in days]
    expect = pd.Series([x for _, x in rows], index=pd.to_datetime([d for d, _ in rows]))
    expect = expect.asfreq("B").ffill().bfill()
    got = values(cal.align_business_days(make_prices({"S": rows})), "date", "close")
    assert [d for d, _ in got] == [d.date() for d in expect.index]
    # a value on a weekend is dropped before the fill, as asfreq does
    assert [x for _, x in got] == pytest.approx(list(expect))


def test_hot_key_is_folded_before_the_shuffle(spark):
    raw = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.lit("2024-01-02 10:00:00").cast("timestamp_ntz").alias("t"),
        (F.col("id") % 7 + 0.25).alias("v"))
    out = cal.daily_mean(raw, "k", "t", "v", name="symbol", out="close")
    assert out.count() == 6668
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("Exchange")  # listed top down


def test_union_alignment(make_prices):
    df = make_prices({"A": [("2024-01-02", 1), ("2024-01-05", 2)], "B": [("2024-01-06", 9)]})
    got = values(cal.align_to_union(df), "symbol", "date", "close", order=("symbol", "date"))
    days = [dt.date(2024, 1, d) for d in (2, 5, 6)]
    assert got == [("A", days[0], 1.0), ("A", days[1], 2.0), ("A", days[2], 2.0),
                   ("B", days[0], 9.0), ("B", days[1], 9.0), ("B", days[2], 9.0)]


def test_exog_outer_fill(make_prices):
    ex = make_prices({"CL=F": [("2024-01-02", 1), ("2024-01-04", 3)], "XLU": [("2024-01-03", 7)]},
                     "value", "code")
    wide = market.exog_wide(ex, ["CL=F", "XLU"])
    assert wide.columns == ["date", "cl_f", "xlu"]
    assert values(wide, "cl_f", "xlu") == [(1.0, 7.0), (1.0, 7.0), (3.0, 7.0)]


def test_market_fills_missing_dates_with_zero(make_prices):
    prices = make_prices({"S": [("2024-01-02", 5), ("2024-01-03", float("inf"))]})
    ex = market.exog_wide(make_prices({"x": [("2024-01-03", 2)]}, "value", "code"), ["x"])
    assert values(market.market_table(prices, ex), "close", "x") == [(5.0, 0.0)]


def test_back_fill_and_forward_fill(line):
    df = line([None, 1, None, 3, None])
    assert values(cal.forward_fill(df, ["close"]), "close") == [None, 1, 1, 3, 3]
    assert values(cal.back_fill(df, ["close"]), "close") == [1, 1, 3, 3, None]
    assert values(cal.fill_gaps(df, ["close"]), "close") == [1, 1, 1, 3, 3]


@pytest.mark.parametrize("steps,bdays", [(7, 5), (180, 126), (365, 252), (30, 30)])
def test_horizon(spark, steps, bdays):
    assert S.business_horizon(steps) == bdays
    assert spark.range(1).select(D.business_horizon(F.lit(steps))).first()[0] == bdays


@pytest.mark.parametrize("last", ["2024-01-05", "2024-01-06"])
def test_future_index(spark, last):
    got = spark.range(1).select(D.next_business_days(F.lit(last).cast("date"), 5)).first()[0]
    assert got == [dt.date(2024, 1, d) for d in (8, 9, 10, 11, 12)]


def test_future_index_all_weekdays(spark):
    got = spark.range(1).select(D.next_business_days(F.lit("2023-12-29").cast("date"), 252)).first()[0]
    assert got == [d.date() for d in pd.bdate_range("2024-01-01", periods=252)]


def _ts(spark, text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("utc,is_open", [
    ("2024-01-10 14:29:59", False), ("2024-01-10 14:30:00", True),
    ("2024-01-10 21:00:00", True), ("2024-01-10 21:00:00.5", False),
    ("2024-01-10 21:00:01", False), ("2024-01-13 15:00:00", False),
    ("2024-03-11 13:29:59", False), ("2024-03-11 13:30:00", True),  # after the clock change
    ("2024-03-11 20:00:00", True), ("2024-03-11 20:00:01", False),
])
def test_market_hours(spark, utc, is_open):
    row = spark.range(1).select(D.market_open(_ts(spark, utc)), D.market_open(_ts(spark, utc), True))
    assert tuple(row.first()) == (is_open, True)


@pytest.mark.parametrize("now,updated,stale", [
    ("2024-01-10 12:29:00", "2024-01-09 12:30:00", False),  # 19:29 Bangkok, cutoff is yesterday
    ("2024-01-10 12:30:00", "2024-01-09 12:30:00", True),   # 19:30, cutoff is today
    ("2024-01-10 12:30:00", "2024-01-10 12:30:00", False),
    ("2024-01-10 12:29:59", "2024-01-09 12:29:59", True),
])
def test_cutoff(spark, now, updated, stale):
    got = spark.range(1).select(D.is_stale(_ts(spark, updated), _ts(spark, now), 19, 30)).first()[0]
    assert got is stale


def test_snapshot_stale_uses_the_local_date(spark):
    # 18:00 UTC on the 9th is already the 10th in Bangkok
    got = spark.range(1).select(
        D.snapshot_stale(_ts(spark, "2024-01-09 18:00:00"), _ts(spark, "2024-01-10 05:00:00")),
        D.snapshot_stale(_ts(spark, "2024-01-09 16:00:00"), _ts(spark, "2024-01-10 05:00:00")),
        D.snapshot_stale(F.lit(None).cast("timestamp_ntz"), _ts(spark, "2024-01-10 05:00:00"))).first()
    assert tuple(got) == (False, True, True)


def test_rules(spark):
    rows = spark.createDataFrame([(5, 200), (30, 6), (126, 300), (252, 300), (400, 300)], "s int, n int")
    got = [tuple(r) for r in rows.select(
        D.seasonal_period("s"), D.stable_seasonal_period("s", "n"),
        D.history_period(F.lit("arima"), "s"), D.history_period(F.lit("LSTM"), "s")).collect()]
    assert got == [(5, 5, "6mo", "10y"), (5, 2, "2y", "10y"), (20, 20, "2y", "10y"),
                   (20, 63, "5y", "10y"), (252, 63, "10y", "10y")]
