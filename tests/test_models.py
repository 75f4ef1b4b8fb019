
import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from tidepanel import settings as S
from tidepanel.plans import arima, drift, evaluate, learned, refresh
from tidepanel.plans.regression import least_squares, product_squares, unpack

RNG = np.random.default_rng(21)


def _ar_series(n=400, phi=0.5, level=100.0):
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + RNG.normal()
    return level + w.cumsum()


def test_unpack_and_least_squares():
    z = RNG.normal(size=(50, 4))
    gram = z.T @ z
    cells = gram[np.triu_indices(4)]
    assert np.allclose(unpack(cells, 4), gram)
    beta, rss = least_squares(gram, [1, 2, 3])
    expect, res, *_ = np.linalg.lstsq(z[:, 1:], z[:, 0], rcond=None)
    assert np.allclose(beta, expect) and rss == pytest.approx(res[0])


def test_difference_weights():
    assert list(arima.difference_weights(1, 0, 0)) == [1, -1]
    assert list(arima.difference_weights(1, 1, 3)) == [1, -1, 0, -1, 1]


def test_ar_on_differences(weekdays):
    y = _ar_series()
    fits = arima.forecast_all(weekdays({"S": list(y)}), models=["arima"], steps=[7], params={},
                              defaults={"arima": (1, 1, 0, 0, 0, 0, 0)})
    got = {r["kind"]: r for r in fits.collect()}
    for kind, train in (("backtest", y[:-5]), ("future", y)):
        d = np.diff(train)
        phi = (d[1:] @ d[:-1]) / (d[:-1] @ d[:-1])
        path, last = [train[-1]], d[-1]
        for _ in range(5):
            last *= phi
            path.append(path[-1] + last)
        assert got[kind]["path"] == pytest.approx(path[1:])
        assert got[kind]["last_price"] == pytest.approx(train[-1])


def test_levels_with_constant_and_two_lags(weekdays):
    y = 50 + np.abs(RNG.normal(size=120).cumsum())
    row = arima.forecast_all(weekdays({"S": list(y)}), models=["arima"], steps=[3], kinds=("future",),
                             params={("S", "arima"): (2, 0, 0, 0, 0, 0, 0)}).first()
    z = np.column_stack([np.ones(118), y[1:-1], y[:-2]])
    beta, *_ = np.linalg.lstsq(z, y[2:], rcond=None)
    hist = list(y)
    for _ in range(3):
        hist.append(beta @ [1, hist[-1], hist[-2]])
    assert row["path"] == pytest.approx(hist[-3:], rel=1e-8)


def _multiplicative(w, m, own, seasonal, start):
    """Coefficients of lags 1..own and m..seasonal*m with their products, by Newton steps on the rows themselves."""
    def residuals(beta):
        one = np.zeros(own + 1)
        one[0], one[1:] = 1, -beta[:own]
        two = np.zeros(seasonal * m + 1)
        two[0], two[m::m] = 1, -beta[own:]
        poly = np.convolve(one, two)
        return np.array([poly @ w[t - len(poly) + 1:t + 1][::-1] for t in range(len(poly) - 1, len(w))])

    beta = np.zeros(own + seasonal)
    for _ in range(60):
        base = residuals(beta)
        jac = np.column_stack([(residuals(beta + 1e-6 * np.eye(len(beta))[i]) - base) / 1e-6 for i in range(len(beta))])
        beta = beta - np.linalg.lstsq(jac, base, rcond=None)[0]
    return beta, residuals(beta)


def test_seasonal_orders_are_multiplicative(weekdays):
    """Ten series against Gauss-Newton on their rows: coefficients, criterion and forecast."""
    m, table = 5, {}
    for k in range(10):
        w = np.zeros(160)
        for t in range(6, 160):
            w[t] = 0.5 * w[t - 1] + 0.4 * w[t - 5] - 0.2 * w[t - 6] + RNG.normal()
        y = np.concatenate([100 + RNG.normal(size=6), np.zeros(160)])
        for t in range(160):
            y[t + 6] = w[t] + y[t + 5] + y[t + 1] - y[t]
        table[f"S{k}"] = list(y)
    fits = arima.forecast_all(weekdays(table), models=["sarima"], steps=[7], kinds=("future",), params={},
                              defaults={"sarima": (1, 1, 0, 1, 1, 0, 20)}).collect()
    assert len(fits) == 10
    for row in fits:
        y = np.array(table[row["symbol"]])
        w = np.diff(y)[m:] - np.diff(y)[:-m]
        beta, res = _multiplicative(w, m, 1, 1, 6)
        assert row["m"] == 5 and row["n_used"] == len(res)
        assert [row["coefs"]["a1"], row["coefs"]["s1"]] == pytest.approx(list(beta), rel=1e-5)
        assert row["aic"] == pytest.approx(len(res) * np.log(res @ res / len(res)) + 4, rel=1e-8)
        hist, ws = list(y), list(w)
        for _ in range(5):
            ws.append(beta[0] * ws[-1] + beta[1] * ws[-m] - beta[0] * beta[1] * ws[-m - 1])
            hist.append(ws[-1] + hist[-1] + hist[-m] - hist[-m - 1])
        assert row["path"] == pytest.approx(hist[-5:], rel=1e-5)


def test_products_by_gauss_newton_leave_no_slope():
    z = RNG.normal(size=(200, 5))
    y = z[:, 0] * 0.5 + z[:, 1] * 0.3 - 0.15 * z[:, 2] + 0.2 * z[:, 3] + RNG.normal(size=200)
    data = np.column_stack([y, z[:, 0], z[:, 1], z[:, 3], z[:, 2]])
    beta, rss = product_squares(data.T @ data, 3, [(0, 1, -1.0)])

    def loss(b):
        r = y - z[:, 0] * b[0] - z[:, 1] * b[1] - z[:, 3] * b[2] + z[:, 2] * b[0] * b[1]
        return float(r @ r)

    assert loss(beta) == pytest.approx(rss)
    for i in range(3):
        step = 1e-5 * np.eye(3)[i]
        assert abs(loss(beta + step) - loss(beta - step)) / 2e-5 < 1e-3


def test_two_stages_equal_regressions_on_the_rows(weekdays):
    """An order with moving-average terms, for the whole series and for a holdout."""
    e = RNG.normal(size=400)
    y = 100 + (e[1:] + 0.6 * e[:-1]).cumsum()
    fits = arima.forecast_all(weekdays({"S": list(y)}), models=["arima"], steps=[7],
                              params={("S", "arima"): (1, 1, 2, 0, 0, 0, 0)}).collect()
    for row in fits:
        w = np.diff(y[:-5] if row["kind"] == "backtest" else y)
        z = np.column_stack([w[8 - b:len(w) - b] for b in range(1, 9)])
        long, *_ = np.linalg.lstsq(z, w[8:], rcond=None)
        res = np.concatenate([np.full(8, np.nan), w[8:] - z @ long])
        x = np.column_stack([w[9:-1], res[9:-1], res[8:-2]])
        beta, *_ = np.linalg.lstsq(x, w[10:], rcond=None)
        assert row["n_used"] == len(w) - 10
        assert [row["coefs"][c] for c in ("a1", "e1", "e2")] == pytest.approx(list(beta), rel=1e-6)
        ws, es, level, path = list(w), list(res), row["last_price"], []
        for _ in range(5):
            ws.append(beta @ [ws[-1], es[-1], es[-2]])
            es.append(0.0)
            level += ws[-1]
            path.append(level)
        assert row["path"] == pytest.approx(path, rel=1e-7)


def test_ten_thousand_paths_in_one_batch_equal_single_ones():
    order = arima.Order(2, 1, 1, 1, 1, 0, 5)
    levels = 100 + RNG.normal(size=(10_000, 40)).cumsum(axis=1)
    coefs = RNG.uniform(-0.4, 0.4, size=(10_000, 8))
    fits = []
    for a1, a2, s1, e1, *first in coefs:
        own = {1: a1, 2: a2, 5: s1, 6: -a1 * s1, 7: -a2 * s1}
        long = dict.fromkeys(order.first_lags(), 0.1) | {0: first[0]}
        fits.append(arima.Fit(order, {"a1": a1}, own, {1: e1}, long, 1.0, 30, 4))
    batch = arima.roll_forward(order, fits, levels, 20)
    for i in range(0, 10_000, 997):
        assert np.array_equal(batch[i], arima.roll_forward(order, [fits[i]], levels[i:i + 1], 20)[0])
    f, y = fits[3], list(levels[3])
    w = [0.0] * 6 + [y[t] - y[t - 1] - y[t - 5] + y[t - 6] for t in range(6, 40)]
    e = [0.0] * 14 + [w[t] - f.first[0] - sum(0.1 * w[t - b] for b in order.first_lags()) for t in range(14, 40)]
    for _ in range(20):
        w.append(sum(c * w[-k] for k, c in f.own.items()) + sum(c * e[-k] for k, c in f.error.items()))
        e.append(0.0)
        y.append(w[-1] + y[-1] + y[-5] - y[-6])
    assert batch[3] == pytest.approx(y[-20:], rel=1e-9)


def test_rows_do_not_grow_with_holdouts_and_orders(weekdays):
    panel = weekdays({"A": list(_ar_series(300)), "B": list(_ar_series(300))})

    def summed(orders, holdouts):
        design = arima.design_of([(o, False) for o in orders], holdouts, ())
        return arima.segment_sums(panel, design).agg(F.sum("n_rows")).first()[0]

    few, many = [arima.Order(1, 1, 0)], [arima.Order(p, 1, 0) for p in range(4)]
    assert summed(few, []) == summed(many, [5, 126, 252]) == 600
    assert summed([*many, arima.Order(1, 0, 1)], [5]) == 1200  # one more differencing


def test_a_table_of_orders_chooses_the_columns(spark, weekdays):
    panel = weekdays({"A": list(_ar_series(300)), "B": list(_ar_series(300, 0.8)), "C": list(_ar_series(300))})
    grid = [arima.Order(p, d, q) for p in range(3) for d in range(2) for q in range(2)]
    table = arima.tuned(panel.where("symbol <> 'C'"), grid, ["arima"])
    chosen = {r["symbol"]: tuple(r[c] for c in arima.ORDER_COLUMNS) for r in table.collect()}
    options = dict(models=["arima"], steps=[7], defaults={"arima": (1, 1, 0, 0, 0, 0, 0)})
    by_table = arima.forecast_all(panel, params=table, grid=grid, **options)
    by_config = arima.forecast_all(panel, params={(s, "arima"): o for s, o in chosen.items()}, **options)
    got, want = ({(r["symbol"], r["kind"]): r for r in f.collect()} for f in (by_table, by_config))
    assert len(got) == 6
    for key, row in got.items():
        assert row["status"] == "ok" and tuple(row[c] for c in arima.ORDER_COLUMNS) == chosen.get(key[0], (1, 1, 0, 0, 0, 0, 0))
        assert row["n_used"] == want[key]["n_used"] and row["path"] == pytest.approx(want[key]["path"], rel=1e-6)
    odd = spark.createDataFrame([("A", "arima", 12, 1, 0, 0, 0, 0)], "symbol string, model string, p int, d int, q int, sp int, sd int, sq int")
    rows = {r["symbol"]: r for r in arima.forecast_all(panel, params=odd, grid=grid, kinds=("future",), **options).collect()}
    assert rows["A"]["status"] == "error" and "not in the grid" in rows["A"]["error"] and rows["B"]["status"] == "ok"
    with pytest.raises(ValueError, match="grid"):
        arima.forecast_all(panel, params=odd, **options)
    only = spark.createDataFrame([("A", "arima", 7)], "symbol string, model string, steps int")
    assert {r["symbol"] for r in arima.forecast_all(panel, params={}, only=only, **options).collect()} == {"A"}


def test_a_null_price_leaves_out_the_rows_that_need_it(weekdays):
    y = list(_ar_series(200))
    df = weekdays({"S": y[:100] + [None] + y[101:]})
    row = arima.forecast_all(df, models=["arima"], steps=[7], kinds=("future",), params={},
                             defaults={"arima": (1, 1, 0, 0, 0, 0, 0)}).first()
    w = np.diff(np.array(y[:100] + [np.nan] + y[101:]))
    a, b = w[1:], w[:-1]
    ok = ~np.isnan(a) & ~np.isnan(b)
    assert row["n_used"] == ok.sum() and row["coefs"]["a1"] == pytest.approx((a[ok] @ b[ok]) / (b[ok] @ b[ok]))


def test_exogenous_with_known_future(weekdays):
    x = 10 + RNG.normal(size=150).cumsum()
    y = 3 * x + _ar_series(150)
    df = weekdays({"S": list(y)}).join(
        weekdays({"S": list(x)}).select("date", F.col("close").alias("oil price")), "date")
    row = arima.forecast_all(df, models=["sarimax"], steps=[7], kinds=("backtest",), exog=("oil price",),
                             exog_mode="actual", params={},
                             defaults={"sarimax": (1, 1, 0, 0, 0, 0, 0)}).first()
    dy, dx = np.diff(y[:-5]), np.diff(x)
    z = np.column_stack([dy[:-1], dx[1:len(dy)]])
    beta, *_ = np.linalg.lstsq(z, dy[1:], rcond=None)
    last, level, path = dy[-1], y[-6], []
    for k in range(5):
        last = beta @ [last, dx[len(dy) + k]]
        level += last
        path.append(level)
    assert row["coefs"]["x1"] == pytest.approx(3, abs=0.3)
    assert row["path"] == pytest.approx(path, rel=1e-8)


def test_moving_average_term_recovers_its_sign(weekdays):
    e = RNG.normal(size=1500)
    y = 100 + (e[1:] + 0.6 * e[:-1]).cumsum()
    row = arima.forecast_all(weekdays({"S": list(y)}), models=["arima"], steps=[7], kinds=("future",),
                             params={("S", "arima"): (0, 1, 1, 0, 0, 0, 0)}).first()
    assert row["coefs"]["e1"] == pytest.approx(0.6, abs=0.08)
    # one step ahead uses the last residual, later steps are flat
    assert np.ptp(row["path"][1:]) == pytest.approx(0, abs=1e-9)


def test_one_bad_key_does_not_stop_the_others(weekdays):
    df = weekdays({"long": list(_ar_series(200)), "short": [1.0, 2.0, 3.0]})
    fits = arima.forecast_all(df, models=["arima"], steps=[7], params={})
    got = {(r["symbol"], r["kind"]): (r["status"], r["error"]) for r in fits.collect()}
    assert got[("long", "backtest")] == ("ok", None)
    assert got[("short", "backtest")][0] == "error"
    assert "too short" in got[("short", "backtest")][1]
    status = {r["symbol"]: r["status"] for r in refresh.status_rows(fits).collect()}
    assert status == {"long": "ok", "short": "error"}


def test_exog_model_without_exog_is_an_error(weekdays):
    row = arima.forecast_all(weekdays({"S": list(_ar_series(100))}), models=["sarimax"], steps=[7],
                             kinds=("future",), params={}).first()
    assert row["status"] == "error" and "required" in row["error"]


def test_full_grid_properties(weekdays):
    df = weekdays({s: list(_ar_series(420)) for s in ("AEP", "DUK", "ZZZ")})
    df = df.withColumn("oil", F.sin(F.unix_date("date") / 9) + 20)
    fits = arima.forecast_all(df, models=["arima", "sarima", "sarimax"], steps=[7, 180],
                              params=S.TUNED_ORDERS, exog=("oil",)).cache()
    assert fits.count() == 3 * 3 * 2 * 2
    assert fits.where("status <> 'ok'").count() == 0
    points = arima.forecast_points(fits)
    sizes = points.groupBy("symbol", "model", "steps", "kind").count().collect()
    assert {(r["steps"], r["count"]) for r in sizes} == {(7, 5), (180, 126)}
    assert points.where(F.weekday("date") > 4).count() == 0
    assert points.where("kind = 'backtest' and actual is null").count() == 0
    metrics = evaluate.backtest_metrics(points.where("kind = 'backtest'"))
    assert metrics.where("mae < 0 or mae is null").count() == 0
    runs = refresh.run_rows(fits, "2024-06-01 00:00:00")
    best = {(r["symbol"], r["steps"]): r for r in evaluate.best_models(runs).collect()}
    least = {(r["symbol"], r["steps"]): r["m"] for r in
             runs.groupBy("symbol", "steps").agg(F.min("backtest_mae").alias("m")).collect()}
    assert {k: r["best_mae"] for k, r in best.items()} == least
    joined = runs.join(metrics.select("symbol", "model", "steps", "mae"), ["symbol", "model", "steps"])
    assert joined.where("abs(mae - backtest_mae) > 1e-9").count() == 0
    # a second run gives the same simulated paths
    again = arima.forecast_points(arima.forecast_all(
        df, models=["sarimax"], steps=[7], params=S.TUNED_ORDERS, exog=("oil",)))
    one = points.where("model = 'sarimax' and steps = 7")
    same = one.join(again.withColumnRenamed("price", "p2"),
                    ["symbol", "steps", "kind", "step"]).where("abs(price - p2) < 1e-9")
    assert same.count() == one.count() == 30


def test_mae3(spark):
    rows = [("S", "m", 7, i + 1, p, y, 10.0) for i, (y, p) in enumerate([(10., 11.), (20., 18.), (30., 30.)])]
    df = spark.createDataFrame(rows, "symbol string, model string, steps int, step int, price double, "
                                     "actual double, last_price double")
    row = evaluate.backtest_metrics(df).first()
    assert row["mae"] == pytest.approx(1.0) and row["rmse"] == pytest.approx((5 / 3) ** 0.5)
    y, p = np.array([10., 20, 30]), np.array([11., 18, 30])
    assert row["smape_pct"] == pytest.approx(200 * np.mean(abs(p - y) / (p + y + 1e-8)))
    assert row["mape_pct"] == pytest.approx(100 * np.mean(abs(p - y) / (y + 1e-8)))
    ry, rp = np.diff(y) / y[:-1], np.diff(p) / p[:-1]
    assert row["mae_ret"] == pytest.approx(np.mean(abs(ry - rp)))
    assert row["mae_norm_pct"] == pytest.approx(100 * np.mean(abs(y / 10 - p / 10)))


def test_diracc(spark):
    rows = [("S", "m", 7, i + 1, p, y, 10.0) for i, (y, p) in enumerate([(10., 10.), (11., 11.), (9., 12.)])]
    df = spark.createDataFrame(rows, "symbol string, model string, steps int, step int, price double, "
                                     "actual double, last_price double")
    assert evaluate.backtest_metrics(df).first()["dir_acc_pct"] == 50.0


def test_tie_models(spark):
    df = spark.createDataFrame([("S", 7, "sarima", 1.0), ("S", 7, "arima", 1.0), ("S", 7, "lstm", None)],
                               "symbol string, steps int, model string, backtest_mae double")
    row = evaluate.best_models(df).first()
    assert (row["best_model"], row["best_mae"]) == ("ARIMA", 1.0)


def test_mae_pct(spark):
    df = spark.createDataFrame([(1.0, 50.0), (None, 50.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(evaluate.mae_pct("a", "b")).collect()] == [2.0, 0.0, 0.0]


def test_order_search_and_global(weekdays):
    df = weekdays({"A": list(_ar_series(300)), "B": list(_ar_series(300, 0.8))})
    scores = arima.order_search(df, arima.ARIMA_GRID)
    assert scores.groupBy("symbol").count().collect()[0]["count"] == len(arima.ARIMA_GRID) == 18
    assert len(arima.SEASONAL_GRID) == 64
    best = arima.best_orders(scores)
    low = {r["symbol"]: r["m"] for r in scores.groupBy("symbol").agg(F.min("aic").alias("m")).collect()}
    assert {r["symbol"]: r["aic"] for r in best.collect()} == low
    total = arima.global_order(best).collect()
    assert sum(r["series"] for r in total) == 2
    assert sum(r["by_sum"] for r in total) == 1 and sum(r["by_mode"] for r in total) == 1


def test_seasonal_search_with_exog(weekdays):
    df = weekdays({"A": list(_ar_series(200))}).withColumn("oil", F.cos(F.unix_date("date") / 5.0))
    best = arima.best_orders(arima.order_search(df, arima.SEASONAL_GRID, ("oil",))).first()
    assert best["m"] == 12 and best["aic"] is not None


def test_drift_paths(weekdays):
    x = [100.0 * 1.01 ** i for i in range(60)]
    fits = {(r["steps"], r["kind"]): r for r in drift.drift_fits(weekdays({"S": x}), [7, 180]).collect()}
    assert fits[(7, "future")]["path"] == pytest.approx([x[-1] * 1.01 ** k for k in range(1, 6)])
    assert [t["actual"] for t in fits[(7, "backtest")]["test"]] == pytest.approx(x[-5:])
    assert fits[(180, "backtest")]["status"] == "error"
    flat = drift.drift_fits(weekdays({"S": [5.0]}), [7]).where("kind = 'future'").first()
    assert flat["path"] == [5.0] * 5
    steep = drift.drift_fits(weekdays({"S": [1.0, 2, 4, 8]}), [7]).where("kind = 'future'").first()
    assert steep["path"][0] == pytest.approx(8 * 1.07)


def test_exog_paths_flat_and_repeatable(make_prices):
    ex = make_prices({"x": [("2024-01-02", 4), ("2024-01-03", 4)]}, "value", "code")
    assert values(drift.exog_paths(ex, 7), "value", order=("step",)) == [4.0] * 5
    ex = make_prices({"x": [("2024-01-02", 4), ("2024-01-03", 5), ("2024-01-04", 4)]}, "value", "code")
    a = values(drift.exog_paths(ex, 180), "value", order=("step",))
    assert a == values(drift.exog_paths(ex, 180), "value", order=("step",))
    assert a != values(drift.exog_paths(ex, 180, seed=8), "value", order=("step",))
    assert len(a) == 126


def test_hashed_normal_is_standard(spark):
    row = spark.range(20000).select(arima.hashed_normal(F.lit(1), F.col("id")).alias("z")).agg(
        F.avg("z"), F.stddev("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03


def test_learned_modes(weekdays):
    df = weekdays({"long": list(_ar_series(400, level=300)), "mid": list(_ar_series(120, level=300)),
                   "short": list(_ar_series(25, level=300))})
    fits = learned.learned_fits(df, [7, 180], lookback=30)
    got = {(r["symbol"], r["steps"], r["kind"]): r for r in fits.collect()}
    assert got[("long", 7, "future")]["used"] == "recursive"
    assert got[("long", 180, "future")]["used"] == "direct"
    assert got[("mid", 180, "future")]["used"] == "recursive"  # too short for the blocks
    assert got[("short", 7, "future")]["used"] == "drift"
    for (symbol, steps, kind), r in got.items():
        if r["status"] != "ok":
            continue
        assert len(r["path"]) == S.business_horizon(steps)
        moves = np.diff([r["last_price"], *r["path"]]) / np.array([r["last_price"], *r["path"][:-1]])
        assert np.all(np.abs(moves) <= S.learned_settings(steps).clip + 1e-12)


def test_learned_model_finds_a_linear_rule(weekdays):
    r = np.zeros(600)
    for t in range(1, 600):
        r[t] = -0.8 * r[t - 1] + RNG.normal() * 0.002
    price = 100 * np.cumprod(1 + r)
    row = learned.learned_fits(weekdays({"S": list(price)}), [7], lookback=5).where(
        "kind = 'future'").first()
    first = row["path"][0] / price[-1] - 1
    assert first == pytest.approx(-0.8 * r[-1], abs=8e-4)


def test_learned_settings():
    assert S.learned_settings(7) == S.LearnedSettings("recursive", 1, 0.07, 0.0)
    assert S.learned_settings(180) == S.LearnedSettings("direct", 5, 0.08, 0.2)


def test_parameters_and_defaults(spark):
    symbols = spark.createDataFrame([("AEP",), ("ZZZ",)], "symbol string")
    grid = arima.work_grid(symbols, ["arima", "sarimax"], [7, 365])
    rows = arima.with_parameters(grid, arima.parameter_rows(spark, S.TUNED_ORDERS), S.STRICT_DEFAULTS)
    got = {(r["symbol"], r["model"], r["steps"]): tuple(r[c] for c in arima.ORDER_COLUMNS)
           for r in rows.collect()}
    assert got[("AEP", "arima", 7)] == (1, 1, 0, 0, 0, 0, 0)
    assert got[("AEP", "sarimax", 365)] == (2, 0, 2, 0, 0, 1, 20)
    assert got[("ZZZ", "arima", 7)] == (2, 1, 0, 0, 0, 0, 0)
    assert got[("ZZZ", "sarimax", 7)] == (1, 0, 0, 0, 1, 1, 5)




def test_a_fit_depends_on_its_own_order_only(spark, make_prices):
    rng = np.random.default_rng(8)
    days = pd.bdate_range("2023-01-02", periods=120)
    panel = make_prices({s: [(d.date(), float(v)) for d, v in zip(days, 100 + rng.normal(size=120).cumsum())]
                         for s in ("S", "OTHER")})
    mine = {("S", "arima"): (1, 1, 0, 0, 0, 0, 0)}
    wide = mine | {("OTHER", "arima"): (2, 1, 2, 0, 0, 0, 0)}

    def fit(params):
        row = arima.forecast_all(panel, models=["arima"], steps=[7], params=params).where(
            "symbol = 'S' and kind = 'future'").first()
        return row["n_used"], row["coefs"]["a1"], row["path"]

    alone, beside = fit(mine), fit(wide)
    assert alone[0] == beside[0] == 118 and np.allclose([alone[1], *alone[2]], [beside[1], *beside[2]], rtol=1e-9)


def test_window_products_equal_the_explicit_matrix():
    products = learned.Products(4, 3, 2, 2)
    xs, ys = [], []
    for n, stop in ((30, 27), (9, 9), (5, 5), (4, 4), (3, 3), (50, 20)):
        z, state, y = RNG.normal(size=(n, 3)), RNG.normal(size=(n, 2)), RNG.normal(size=(max(stop - 4, 0), 2))
        products.add(z, state, y, stop)
        for k, t in enumerate(range(4, stop)):
            xs.append(np.concatenate([[1.0], *(z[t - i] for i in range(1, 5)), state[t - 1]]))
            ys.append(y[k])
    x, y = np.array(xs), np.array(ys)
    assert np.allclose(products.matrix(), x.T @ x) and np.allclose(products.targets, x.T @ y)


def test_learned_model_equals_a_ridge_on_the_explicit_windows(weekdays):
    """Two series with a windowed feature and a state; one-step paths from the solved coefficients."""
    table = {"A": 100 * np.cumprod(1 + 0.01 * RNG.normal(size=90)), "B": 50 * np.cumprod(1 + 0.02 * RNG.normal(size=70))}
    df = weekdays({k: list(v) for k, v in table.items()})
    df = df.withColumn("x", F.sin(F.unix_date("date") * 1.0)).withColumn("s", F.cos(F.unix_date("date") * 0.7))
    got = {(r["symbol"], r["kind"]): r for r in learned.learned_fits(df, [7], ["s"], 6, ["x"]).collect()}
    data = {k: df.where(F.col("symbol") == k).orderBy("date").toPandas().iloc[1:] for k in table}
    for held, kind in ((0, "future"), (5, "backtest")):
        xs, ys, ends = [], [], {}
        for k, part in data.items():
            v = np.column_stack([table[k][1:] / table[k][:-1] - 1, part["x"], part["s"]])[:len(part) - held]
            z = (v - v.mean(axis=0)) / v.std(axis=0)
            xs += [np.concatenate([[1], z[t - 6:t][::-1, :2].ravel(), z[t - 1, 2:]]) for t in range(6, len(z))]
            ys += list(z[6:, 0])
            ends[k] = (z, v)
        x, y = np.array(xs), np.array(ys)
        penalty = np.eye(x.shape[1]) * learned.RIDGE * len(x)
        penalty[0, 0] = 0
        beta = np.linalg.solve(x.T @ x + penalty, x.T @ y)
        for k, (z, v) in ends.items():
            window, path, price = z[:, :2].copy(), [], table[k][len(v)]
            for _ in range(5):
                nxt = beta @ np.concatenate([[1], window[-6:][::-1].ravel(), z[-1, 2:]])
                window = np.vstack([window, [nxt, window[-1, 1]]])
                price *= 1 + np.clip(nxt * v[:, 0].std() + v[:, 0].mean(), -0.07, 0.07)
                path.append(price)
            row = got[(k, kind)]
            assert row["used"] == "recursive" and row["path"] == pytest.approx(path, rel=1e-9)
            assert row["drift"] == pytest.approx(v[:, 0].mean()) and len(row["test"]) == held


def test_a_large_batch_of_fits_is_not_held_as_objects():
    """8,000 keys with 256 last prices each: their rows are Python objects a slice at a time."""
    import tracemalloc

    import pyarrow as pa

    design = arima.design_of([(arima.Order(1, 1, 0), False)], [5, 126, 252], ())
    kind = pa.struct([("kind", pa.int32()), ("seg", pa.int32()), ("known", pa.int64()), ("n_rows", pa.int64()),
                      ("gram", pa.list_(pa.float64())), ("moves", pa.list_(pa.list_(pa.float64())))])
    # one, value and lag of 400 rows with mean zero
    parts = [{"kind": 0, "seg": s, "known": 1, "n_rows": 100, "gram": [100.0, 0.0, 0.0, 90.0, 40.0, 80.0], "moves": []} for s in range(4)]
    rows, steps = 8_000, np.arange(8_000) % 6
    closes = np.add.outer(np.arange(rows), 100 + np.sin(np.arange(design.tail)))
    ahead = np.array([5, 126, 252])[steps % 3]
    columns = {name: pa.array(np.full(rows, v, np.int32)) for name, v in zip(arima.ORDER_COLUMNS, (1, 1, 0, 0, 0, 0, 0))}
    columns |= {"h": pa.array(ahead), "held": pa.array(np.where(steps < 3, 0, ahead)), "kind": pa.array(np.where(steps < 3, "future", "backtest")),
                "use_exog": pa.array([False] * rows), "n": pa.array(np.full(rows, 1_801)), "parts": pa.array([parts] * rows, pa.list_(kind)),
                "closes": pa.ListArray.from_arrays(np.arange(0, closes.size + 1, design.tail), closes.ravel())}
    batch = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    run = arima.forecast_batch(design, "simulated")
    few = run(batch.slice(0, 6))
    tracemalloc.start()
    found = run(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert found.slice(0, 6).equals(few) and set(found.field(0).to_pylist()) == {"ok"}
    assert found.field(4)[0].as_py() == [("a1", pytest.approx(0.5))]
    last = closes[3, design.tail - 6:design.tail - 5].item()
    move = last - closes[3, design.tail - 7].item()
    assert found.field(5)[3].as_py() == pytest.approx([last + move * sum(0.5 ** j for j in range(1, i + 1)) for i in range(1, 6)])


def test_scores_of_a_large_batch_are_not_held_as_objects(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(arima, "SLICE", 50)
    orders = [arima.Order(p, 1, 0) for p in range(4)]
    design = arima.design_of([(o, False) for o in orders], [], (), shared=True)
    rnd = np.random.default_rng(2)
    z = np.column_stack([np.ones(300), rnd.normal(size=(300, 4))])
    part = {"kind": 0, "seg": 0, "known": 1, "n_rows": 300, "gram": (z.T @ z)[np.triu_indices(5)].tolist(), "moves": []}
    kind = pa.struct([("kind", pa.int32()), ("seg", pa.int32()), ("known", pa.int64()), ("n_rows", pa.int64()),
                      ("gram", pa.list_(pa.float64())), ("moves", pa.list_(pa.list_(pa.float64())))])
    rows = 2_000
    numbers, parts = pa.array(np.zeros(rows, np.int32)), pa.array([[part] * 8] * rows, pa.list_(kind))
    run = arima.score_batch(design, orders, False)
    run(numbers.slice(0, 50), parts.slice(0, 50))
    tracemalloc.start()
    found = run(numbers, parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    assert len(found) == rows and [r["rank"] for r in found[rows - 1].as_py()] == [0, 1, 2, 3]
    y, n = z[:, 1], 2400
    assert found[0].as_py()[0]["n_used"] == n
    assert found[0].as_py()[0]["aic"] == pytest.approx(n * np.log(8 * (y @ y) / n))
