import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from tidepanel.operators import ewm, indicators as ind, rolling as roll


def test_ema5(line):
    out = ewm.with_ewm(line([1, 2, 3, 4, 5]), {"e": ("close", 0.5)})
    assert values(out, "e") == pytest.approx([1, 1.5, 2.25, 3.125, 4.0625])


@pytest.mark.parametrize("alpha", [0.001, 2 / 51, 1 / 14, 0.2, 0.5, 0.9])
def test_ewm_over_many_blocks(spark, alpha):
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(100, 30, 3109)).cumsum()[::-1].copy()
    start = dt.date(1990, 1, 1)
    rows = [("S", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = values(ewm.with_ewm(df, {"e": ("close", alpha)}), "e")
    expect = pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    assert np.allclose(got, expect, rtol=1e-12, atol=0)


def test_ewm_block_size():
    assert 2e-18 > (1 - 2 / 51) ** ewm.block_rows([2 / 51, 0.2])
    with pytest.raises(ValueError):
        ewm.block_rows([0.001, 0.9])
    assert ewm.scans([0.9, 0.001, 0.01]) == [[0.001, 0.01], [0.9]] or len(ewm.scans([0.9, 0.001, 0.01])) >= 2


def test_ewm_far_spans_and_leading_nulls(line):
    df = line([None, 100.0, 100.0, 50.0, 60.0] + [70.0] * 40)
    out = ewm.with_ewm(df, {"fast": ("close", 2 / 11), "slow": ("close", 2 / 201), "most": ("close", 0.9)})
    x = pd.Series([100.0, 100.0, 50.0, 60.0] + [70.0] * 40)
    for name, alpha in (("fast", 2 / 11), ("slow", 2 / 201), ("most", 0.9)):
        got = values(out, name)
        assert got[0] is None and np.allclose(got[1:], x.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-12)


def test_rsi_flat_and_up(weekdays):
    df = weekdays({"flat": [5] * 20, "up": list(range(1, 21))})
    out = ind.rsi(df)
    assert set(values(out, "rsi14")) == {100.0}
    strict = values(ind.rsi(df, strict=True).where("symbol = 'up'"), "rsi14")
    assert strict[:13] == [None] * 13 and strict[13] == 100.0


def test_rsi_matches_definition(weekdays):
    x = pd.Series([10, 11, 10.5, 12, 11, 11.5, 13, 12.5, 12, 14, 13, 15, 14.5, 16, 15.5, 17])
    d = x.diff().fillna(0)
    up = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    down = (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    expect = np.where(down == 0, 100, 100 - 100 / (1 + up / down.where(down != 0, 1)))
    assert values(ind.rsi(weekdays({"S": list(x)})), "rsi14") == pytest.approx(list(expect))


def test_macd_and_signal(weekdays):
    rng = np.random.default_rng(2)
    x = pd.Series(100 + rng.normal(size=80).cumsum())
    line_ = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    signal = line_.ewm(span=9, adjust=False).mean()
    out = values(ind.macd(weekdays({"S": list(x)})), "macd", "macd_signal")
    assert np.allclose(out, np.column_stack([line_, signal]))
    strict = values(ind.macd(weekdays({"S": list(x)}), strict=True), "macd", "macd_signal")
    assert strict[24][0] is None and strict[25][0] is not None
    assert strict[32][1] is None and strict[33][1] is not None


def test_bollinger_flat_band(weekdays):
    out = values(ind.bollinger(weekdays({"S": [3.0] * 25})), "bb_pct")
    assert out == [0.0] * 25
    strict = values(ind.bollinger(weekdays({"S": [3.0] * 25}), strict=True), "bb_pct")
    assert strict == [None] * 25


def test_indicator_matrix_has_no_nulls(weekdays):
    out = ind.indicator_matrix(weekdays({"A": [0.0] * 5, "B": list(range(1, 40))}))
    assert out.dropna(how="any").count() == 44


def test_pct_zero(line):
    assert values(roll.with_returns(line([0, 5, 10])), "ret") == [None, None, 1.0]


def test_log_difference_needs_positive(line):
    out = values(roll.with_returns(line([0, 1, np.e])), "log_ret")
    assert out[:2] == [None, None] and out[2] == pytest.approx(1.0)


def test_moving_average_null_until_full(line):
    out = values(roll.moving_averages(line(list(range(1, 52)))), "ma50")
    assert out[:49] == [None] * 49 and out[49:] == [25.5, 26.5]


def test_volatility_variants(line):
    rng = np.random.default_rng(4)
    x = pd.Series(100 + rng.normal(size=30).cumsum())
    r = x.pct_change()
    got = values(roll.rolling_volatility(line(list(x))), "vol_any", "vol_pct", "vol_scaled_pct")
    any_ = r.rolling(20, min_periods=1).std().fillna(0)
    full = r.rolling(20).std()
    assert [g[0] for g in got] == pytest.approx(list(any_))
    assert got[19][1] is None
    assert [g[1] for g in got[20:]] == pytest.approx(list(full[20:] * 100))
    assert [g[2] for g in got[20:]] == pytest.approx(list(full[20:] * np.sqrt(20) * 100))
    level = values(roll.level_volatility(line(list(x))), "level_vol")
    assert level[18] is None and level[19:] == pytest.approx(list(x.rolling(20).std(ddof=0)[19:]))


def test_downsample(line):
    out = values(roll.downsample(line(list(range(1, 11))), 7), "close")
    assert out == [1, 8, 10]


def test_slices(line):
    df = line(list(range(40)))
    assert len(values(roll.trading_range(df, "1mo"), "close")) == 21
    assert len(values(roll.trading_range(df, "all"), "close")) == 40
    assert values(roll.period_slice(df, "7d"), "close") == list(range(33, 40))
    assert values(roll.calendar_range(df, "1mo"), "date")[0] == dt.date(2024, 1, 9)
    assert len(values(roll.calendar_range(df, "ytd"), "close")) == 40


def test_compounding_inverts_returns(line):
    x = [10.0, 11, 9, 9.5, 20]
    rows = roll.with_returns(line(x)).where("ret is not null")
    back = roll.compounded(rows, "ret", F.lit(10.0), ["symbol"], "date")
    assert values(back, "price") == pytest.approx(x[1:])


def test_split_and_holdout(line):
    df = line(list(range(10)))
    assert sum(values(roll.chronological_split(df), "is_train")) == 8
    assert values(roll.holdout(df, 3), "is_test") == [False] * 7 + [True] * 3


def test_outliers_winsor_and_median(line):
    x = [0.01, -0.01] * 15 + [0.9] + [0.01, -0.01]
    rows = line(x).withColumnRenamed("close", "ret")
    s = pd.Series(x)
    z = (s - s.mean()) / s.std(ddof=0)
    assert values(roll.zscores(rows), "z") == pytest.approx(list(z))
    assert sum(values(roll.zscores(rows), "outlier")) == 1
    wide = values(roll.winsorized(rows), "clipped")
    assert max(wide) == pytest.approx(s.mean() + 3 * s.std())
    zero = values(roll.winsorized(rows, center="zero"), "clipped")
    assert max(zero) == pytest.approx(3 * s.std())
    cleaned = values(roll.rolling_median_replaced(rows), "cleaned")
    assert cleaned[30] == pytest.approx(0.01) and cleaned[:30] == x[:30]


def test_relative_performance(weekdays):
    df = weekdays({"A": [10, 20, 30], "B": [5, 5, 10]})
    bench = df.where("symbol = 'B'")
    for by in ("date", "position"):
        out = roll.relative_performance(df, bench, by=by).where("symbol = 'A'")
        assert values(out, "relative_pct") == pytest.approx([0, 100, 100])


def test_seasonal_difference(line):
    assert values(roll.seasonal_difference(line([1, 2, 4, 8]), 2), "seasonal_diff") == [
        None, None, 3.0, 6.0]


def test_trailing_means_equal_their_frames(line):
    rng = np.random.default_rng(4)
    x = [None if i % 17 == 3 else float(v) for i, v in enumerate(1e6 * rng.normal(size=400))]
    df = roll.trailing_means(line(x), "close", {"a": 5, "b": 37})
    got = values(df, "a", "b")
    for i, (a, b) in enumerate(got):
        for mean, rows in ((a, 5), (b, 37)):
            part = x[max(i - rows + 1, 0):i + 1]
            if len(part) < rows or None in part:
                assert mean is None
            else:
                assert mean == pytest.approx(sum(part) / rows, abs=1e-6)
