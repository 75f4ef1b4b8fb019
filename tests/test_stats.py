import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from tidepanel.operators import correlation, decompose, samples, stats, unitroot
from tidepanel.operators.rolling import pct_change


def test_describe_matches_pandas(line):
    x = pd.Series([1.0, 2, 4, 9, 11, 3.5])
    row = stats.describe(line(list(x))).first()
    d = x.describe()
    got = [row[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
    assert got == pytest.approx(list(d))
    assert row["skew"] == pytest.approx(x.skew()) and row["kurtosis"] == pytest.approx(x.kurt())


def test_missing_report(make_prices):
    df = make_prices({"A": [("2024-01-02", 1), ("2024-01-03", 1)],
                      "B": [("2024-01-03", 1), ("2024-01-06", 1)]})
    got = {r["symbol"]: (r["rows"], r["missing"], r["missing_pct"])
           for r in stats.missing_report(df).collect()}
    assert got == {"A": (2, 0, 0.0), "B": (2, 1, 50.0)}


def test_histogram_matches_numpy(line):
    x = np.random.default_rng(0).normal(size=300)
    df = line(list(x))
    got = {r["bin"]: r["n"] for r in stats.histogram(df, "close").collect()}
    counts, _ = np.histogram(x, bins=50)
    assert sum(got.values()) == 300
    assert [got.get(i, 0) for i in range(50)] == list(counts)


def test_flat_histogram(line):
    assert [tuple(r) for r in stats.histogram(line([2, 2, 2]), "close").collect()] == [("S", 0, 3)]


def test_standardized_flat_and_train(line):
    df = line([1.0, 2, 3, 100]).withColumn("train", F.col("close") < 50).withColumn("flat", F.lit(4.0))
    out = stats.standardized(df, ["close", "flat"], train="train")
    assert values(out, "close_mean")[0] == 2.0
    assert values(out, "close_z")[:3] == pytest.approx([-1.224744871, 0, 1.224744871])
    assert values(out, "flat_z") == [0.0] * 4


def test_correlation_matrix_against_numpy(spark, weekdays):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(7, 60)).cumsum(axis=1)
    base[6] = 3.0  # flat series
    df = weekdays({f"s{i}": list(r) for i, r in enumerate(base)})
    df = df.where("not (symbol = 's2' and date = '2024-01-10')")  # one incomplete date
    kept = np.delete(base, 7, axis=1)
    for buckets, chunk in ((1, 4096), (3, 16)):
        got = correlation.correlation_matrix(df, "close", buckets=buckets, chunk=chunk).collect()
        assert len(got) == 49
        for r in got:
            i, j = int(r["left_key"][1]), int(r["right_key"][1])
            if 6 in (i, j):
                assert r["corr"] is None
            else:
                assert r["corr"] == pytest.approx(np.corrcoef(kept[i], kept[j])[0, 1])
    zero = correlation.correlation_matrix(df, "close", zero_if_flat=True).where("left_key = 's6'")
    assert {r["corr"] for r in zero.collect()} == {0.0}


def test_additive_decomposition(weekdays):
    season = np.tile([1.0, -2, 3, -2], 10)
    x = np.arange(40) * 0.5 + season
    df = weekdays({"S": list(x)})
    out = values(decompose.decompose_additive(df, 4), "close", "trend", "seasonal", "resid")
    inside = [r for r in out if r[1] is not None]
    assert len(inside) == 36 and out[0][1] is None and out[-1][1] is None
    assert all(c == pytest.approx(t + s + e) for c, t, s, e in inside)
    assert [r[2] for r in out[:4]] == pytest.approx(list(season[:4] - season[:4].mean()))
    odd = values(decompose.decompose_additive(df, 5), "trend")
    assert odd[2] == pytest.approx(x[:5].mean()) and odd[1] is None


def test_robust_decomposition_ignores_one_spike(weekdays):
    x = [10.0] * 60
    x[30] = 1000.0
    out = values(decompose.decompose_robust(weekdays({"S": x}), 6), "trend", "seasonal", "resid")
    assert {r[0] for r in out} == {10.0}
    assert out[30][2] == pytest.approx(990.0) and out[29][2] == pytest.approx(0.0)


def _acf(x, lags):
    c = x - x.mean()
    return [1.0] + [float((c[k:] * c[:-k]).sum() / (c * c).sum()) for k in range(1, lags + 1)]


def test_acf_and_pacf(weekdays):
    rng = np.random.default_rng(8)
    x = np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    df = weekdays({"S": list(x)})
    rho = _acf(x, 8)
    assert values(unitroot.acf(df, "close", 8), "acf", order=("lag",)) == pytest.approx(rho)
    expect = [1.0]
    for k in range(1, 9):  # Yule-Walker system of each order
        m = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        expect.append(np.linalg.solve(m, rho[1:k + 1])[-1])
    assert values(unitroot.pacf(df, "close", 8), "pacf", order=("lag",)) == pytest.approx(expect)


def _adf_by_hand(x):
    def fit(p, start):
        dx = np.diff(x)
        rows = range(start, len(dx))
        z = np.array([[x[t], 1.0, *[dx[t - i] for i in range(1, p + 1)]] for t in rows])
        y = dx[start:]
        beta, *_ = np.linalg.lstsq(z, y, rcond=None)
        e = y - z @ beta
        s2 = e @ e / (len(y) - z.shape[1])
        t = beta[0] / math.sqrt(s2 * np.linalg.inv(z.T @ z)[0, 0])
        return t, len(y) * math.log(e @ e / len(y)) + 2 * z.shape[1], len(y)
    depth = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
    best = min(range(depth + 1), key=lambda p: (fit(p, depth)[1], p))
    t, _, n = fit(best, best)
    return best, n, t


@pytest.mark.parametrize("phi", [0.5, 1.0])
def test_adf_against_direct_regression(weekdays, phi, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.zeros(260)
    for t in range(2, 260):
        x[t] = phi * x[t - 1] + 0.3 * (x[t - 1] - x[t - 2]) + rng.normal()
    row = unitroot.adf(weekdays({"S": list(x)}), "close").first()
    best, n, stat = _adf_by_hand(x)
    assert (row["used_lag"], row["n"]) == (best, n)
    assert row["statistic"] == pytest.approx(stat, rel=1e-6)
    assert row["stationary"] is (phi < 1)


def test_mackinnon_points():
    # 5 % critical value of the constant case
    assert unitroot.mackinnon_p(-2.86) == pytest.approx(0.05, abs=2e-3)
    assert unitroot.mackinnon_p(-3.43) == pytest.approx(0.01, abs=1e-3)
    assert unitroot.mackinnon_p(5) == 1.0 and unitroot.mackinnon_p(-30) == 0.0


def test_lookback_and_blocks(line):
    df = line([float(i) for i in range(1, 13)])
    out = samples.lookback_samples(df, ["close"], "close", 3)
    rows = out.orderBy("date").collect()
    assert len(rows) == 9
    assert [w["close"] for w in rows[0]["window"]] == [1, 2, 3] and rows[0]["target"] == 4
    blocks = samples.block_targets(df, "close", 2, 2, 3).orderBy("date").collect()
    # rows 4..8 (12 rows, 4 ahead, strictly before the last)
    assert [list(r["targets"]) for r in blocks][0] == [4 + 5, 6 + 7]
    assert len(blocks) == 5


def test_mean_drift(weekdays):
    rng = np.random.default_rng(3)
    x = pd.Series(100 + rng.normal(size=100).cumsum())
    r = x.pct_change().dropna()
    row = stats.mean_drift(weekdays({"S": list(x)}).withColumn("ret", pct_change("close"))).first()
    assert row["drift_all"] == pytest.approx(r.mean())
    assert row["drift_last"] == pytest.approx(r[-60:].mean())


def test_normalized_exog(make_prices):
    df = make_prices({"x": [("2024-01-01", 1), ("2024-01-02", 3)]}, "value", "code")
    std = math.sqrt(2)
    assert values(stats.normalized_exog(df), "normalized") == pytest.approx(
        [-1 / (std + 1e-6), 1 / (std + 1e-6)])


def test_pair_correlation_against_numpy(spark, weekdays):
    rng = np.random.default_rng(17)
    table = {f"s{i}": list(rng.normal(size=90).cumsum()) for i in range(12)} | {"flat": [2.0] * 90}
    df = weekdays(table)
    names = [("s0", "s1"), ("s1", "s0"), ("s3", "s3"), ("s0", "s1"), ("s4", "s11"), ("s2", "none"), (None, "s1"), ("s5", "flat")]
    pairs = spark.createDataFrame(names, "left_key string, right_key string")
    for size, chunk in ((256, 4096), (3, 40)):
        got = {(r[0], r[1]): r[2] for r in correlation.pair_correlation(df, pairs, "close", size=size, chunk=chunk).collect()}
        assert set(got) == {("s0", "s1"), ("s1", "s0"), ("s3", "s3"), ("s4", "s11"), ("s5", "flat")}
        assert got.pop(("s5", "flat")) is None
        for (a, b), value in got.items():
            assert value == pytest.approx(np.corrcoef(table[a], table[b])[0, 1])
    zero = correlation.pair_correlation(df, pairs, "close", zero_if_flat=True).where("right_key = 'flat'").first()
    assert zero["corr"] == 0.0
    assert correlation.pair_correlation(df, pairs.limit(0), "close").collect() == []


def test_correlation_blocks_do_not_grow_with_the_series(spark, make_prices, monkeypatch):
    """One bucket asked for and 60 series: blocks of 7, read from files; nothing grouped or joined for the products."""
    monkeypatch.setattr(correlation, "ROWS", 7, raising=False)
    data = np.random.default_rng(8).normal(size=(60, 40)).cumsum(axis=1)
    start = dt.date(2024, 1, 1)
    df = make_prices({f"s{i}": [(start + dt.timedelta(days=j), x) for j, x in enumerate(row)] for i, row in enumerate(data)})
    found = correlation.correlation_matrix(df, "close", buckets=1, chunk=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert found.rdd.getNumPartitions() >= 45
    got, want = {(r[0], r[1]): r[2] for r in found.collect()}, np.corrcoef(data)
    assert len(got) == 3_600 == found.count()
    assert all(abs(got[f"s{i}", f"s{j}"] - want[i, j]) < 1e-12 for i in range(60) for j in range(60))
