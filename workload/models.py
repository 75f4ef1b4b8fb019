"""Forecasts, backtests, leaderboards and order search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import settings as S
from tidepanel.functions import scalars as X
from tidepanel.functions.dates import (business_horizon, history_period, seasonal_period,
                                       stable_seasonal_period)
from tidepanel.operators import calendar as cal, rolling as roll
from tidepanel.plans import arima, drift, evaluate
from workload import inputs as I
from workload.panel import market_frame, r
from workload.registry import part, query, sql

# own choice of orders for some of the priority series: short lags, one with a moving average
PARAMS = {
    ("1-URGENT", "arima"): (2, 0, 0, 0, 0, 0, 0),
    ("1-URGENT", "sarimax"): (1, 1, 1, 0, 0, 0, 20),
    ("4-NOT SPECIFIED", "sarima"): (1, 0, 0, 1, 1, 0, 20),
    ("5-LOW", "arima"): (3, 1, 1, 0, 0, 0, 0),
}
AR1 = {"arima": (1, 1, 0, 0, 0, 0, 0)}


# ---- grids and rules --------------------------------------------------------
@query("forecast_grid", sql("""
  SELECT symbol, model, CAST(steps AS INTEGER) AS steps,
    CAST(CASE steps WHEN 7 THEN 5 WHEN 180 THEN 126 WHEN 365 THEN 252 ELSE steps END AS INTEGER) AS h
  FROM (SELECT DISTINCT symbol FROM prices), (SELECT UNNEST(['arima','sarima','sarimax','lstm']) AS model),
    (SELECT UNNEST([7, 30, 180, 365]) AS steps)""", "prices"))
def _(spark, folder):
    symbols = I.prices(spark, folder).select("symbol").distinct()
    return arima.work_grid(symbols, S.MODELS, [7, 30, 180, 365]).withColumn(
        "h", business_horizon("steps"))


@query("param_lookup", sql("""
  , cfg(symbol, model, p, d, q, P_, D_, Q_) AS (VALUES ('1-URGENT','arima',2,0,0,0,0,0), ('1-URGENT','sarimax',1,1,1,0,0,0),
    ('4-NOT SPECIFIED','sarima',1,0,0,1,1,0), ('5-LOW','arima',3,1,1,0,0,0))
  SELECT g.symbol, g.model, CAST(steps AS INTEGER) AS steps, COALESCE(p, 2)::INTEGER AS p, COALESCE(d, 1)::INTEGER AS d, COALESCE(q, 0)::INTEGER AS q,
    (CASE WHEN g.model = 'arima' THEN 0 ELSE COALESCE(P_, 1) END)::INTEGER AS sp,
    (CASE WHEN g.model = 'arima' THEN 0 ELSE COALESCE(D_, 1) END)::INTEGER AS sd,
    (CASE WHEN g.model = 'arima' THEN 0 ELSE COALESCE(Q_, 0) END)::INTEGER AS sq,
    (CASE WHEN g.model = 'arima' THEN 0 WHEN steps = 7 THEN 5 ELSE 20 END)::INTEGER AS m
  FROM (SELECT DISTINCT symbol FROM prices) s, (SELECT UNNEST(['arima','sarima','sarimax']) AS model) g0(model),
    (SELECT UNNEST([7, 180, 365]) AS steps) st, LATERAL (SELECT s.symbol AS symbol, g0.model AS model) g
  LEFT JOIN cfg ON cfg.symbol = g.symbol AND cfg.model = g.model""", "prices"))
def _(spark, folder):
    symbols = I.prices(spark, folder).select("symbol").distinct()
    grid = arima.work_grid(symbols, ["arima", "sarima", "sarimax"], [7, 180, 365])
    return arima.with_parameters(grid, arima.parameter_rows(spark, PARAMS)).select(
        "symbol", "model", "steps", "p", "d", "q", "sp", "sd",
        "sq", "m")


@query("seasonal_rule", sql("""
  SELECT symbol, CAST(steps AS INTEGER) AS steps, CAST(n AS BIGINT) AS n,
    CAST(CASE WHEN steps <= 30 THEN 5 WHEN steps <= 365 THEN 20 ELSE 252 END AS INTEGER) AS m,
    CAST(LEAST(CASE WHEN steps <= 30 THEN 5 WHEN steps <= 180 THEN 20 ELSE 63 END, GREATEST(2, n // 3)) AS INTEGER) AS stable_m,
    CASE WHEN steps <= 7 THEN '6mo' WHEN steps <= 180 THEN '2y' WHEN steps <= 365 THEN '5y' ELSE '10y' END AS period
  FROM (SELECT symbol, COUNT(*) // 50 AS n FROM prices GROUP BY 1), (SELECT UNNEST([5, 7, 126, 252, 400]) AS steps)""", "prices"))
def _(spark, folder):
    sizes = I.prices(spark, folder).groupBy("symbol").agg(
        F.floor(F.count("*") / 50).cast("long").alias("n"))
    rows = sizes.withColumn("steps", F.explode(F.array(*[F.lit(s) for s in (5, 7, 126, 252, 400)])))
    return rows.select(
        "symbol", "steps", "n", seasonal_period("steps").cast("int").alias("m"),
        stable_seasonal_period("steps", "n").cast("int").alias("stable_m"),
        history_period(F.lit("arima"), "steps").alias("period"))


@query("tuned_settings", sql("""
  SELECT symbol, CAST(steps AS INTEGER) AS steps, CAST(CASE WHEN symbol = '7' AND steps >= 360 THEN 200 WHEN symbol = '9' AND steps >= 360 THEN 180
      WHEN h > 130 THEN 180 ELSE 150 END AS INTEGER) AS lookback,
    CASE WHEN h <= 63 THEN 0.07 ELSE 0.08 END::DOUBLE AS clip, 0.2::DOUBLE AS blend, 5::INTEGER AS agg_step
  FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol FROM lineitem),
    (VALUES (7, 5), (180, 126), (200, 200), (365, 252), (400, 400)) t(steps, h)"""))
def _(spark, folder):
    """Window settings by symbol and horizon; two suppliers stand for the tuned symbols."""
    from tidepanel.plans.learned import with_tuned_settings

    symbols = I.table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol")).distinct()
    rules = [({"SO": "7", "ED": "9"}.get(name), *rest) for name, *rest in S.TUNED_WINDOWS]
    grid = arima.work_grid(symbols, ["lstm"], [7, 180, 200, 365, 400])
    return with_tuned_settings(grid, rules).select("symbol", "steps", "lookback", "clip", "blend", "agg_step")


# ---- paths ------------------------------------------------------------------
@query("compound_path", sql("""
  SELECT symbol, date, ROUND(first_close * EXP(SUM(LN(1 + ret)) OVER (PARTITION BY symbol ORDER BY date)) + 1e-5, 3) AS price
  FROM (SELECT symbol, date, ret, FIRST_VALUE(close) OVER (PARTITION BY symbol ORDER BY date) AS first_close FROM rets)
  WHERE ret IS NOT NULL""", "rets"))
def _(spark, folder):
    base = I.returns(spark, folder).withColumn(
        "first_close", F.first("close").over(cal.series()))
    rows = base.where(F.col("ret").isNotNull())
    return roll.compounded(rows, "ret", "first_close", ["symbol"], "date").select(
        "symbol", "date", F.round(F.col("price") + 1e-5, 3).alias("price"))


@query("drift_blend", sql("""
  , d AS (SELECT symbol, AVG(ret) AS mu, MAX(n) AS n FROM rets GROUP BY 1),
  l AS (SELECT symbol, ret, rn - (n - 126) AS k FROM rets WHERE rn > n - 126)
  SELECT l.symbol, CAST(k AS INTEGER) AS step,
    ROUND(LEAST(GREATEST((1 - 0.2::DOUBLE * k / 126) * ret + 0.2::DOUBLE * k / 126 * mu, -0.08), 0.08), 8) AS blended,
    CAST(CEIL(k / 5.0) AS INTEGER) AS block,
    CAST(CASE WHEN CEIL(k / 5.0) < 26 THEN 5 ELSE 126 - 5 * 25 END AS INTEGER) AS block_days,
    ROUND(EXP(LN(1 + ret) / CASE WHEN CEIL(k / 5.0) < 26 THEN 5 ELSE 1 END) - 1, 8) AS per_day
  FROM l JOIN d ON d.symbol = l.symbol""", "rets"))
def _(spark, folder):
    from pyspark.sql import Window as W

    rows = roll.numbered(I.returns(spark, folder)).withColumns({
        "mu": F.avg("ret").over(W.partitionBy("symbol")),
        "step": (F.col("rn") - (F.col("n") - 126)).cast("int"),
    }).where(F.col("step") > 0)
    block = F.ceil(F.col("step") / 5).cast("int")
    days = X.block_days(block, F.lit(26), F.lit(126), 5).cast("int")
    mixed = X.clip(X.blend("ret", "mu", "step", F.lit(126), 0.2), 0.08)
    return rows.select(
        "symbol", "step", F.round(mixed, 8).alias("blended"), block.alias("block"),
        days.alias("block_days"),
        F.round(X.spread_block(F.log1p("ret"), days), 8).alias("per_day"))


@query("exog_paths")
def _(spark, folder):
    aligned = cal.align_to_common(I.exog(spark, folder), "code", "value")
    return drift.exog_paths(aligned, 180).select("code", "step", "date", r("value", 4))


@query("exog_paths_flat", sql("""
  SELECT code, CAST(step AS INTEGER) AS step, date, ROUND(LN(last * POWER(1 + mu, step)), 8) AS log_value FROM (
    SELECT code, last, mu, d AS date, ROW_NUMBER() OVER (PARTITION BY code ORDER BY d) AS step FROM (
      SELECT code, arg_max(value, date) AS last, AVG(x) AS mu,
        CAST(UNNEST(generate_series(CAST(MAX(date) AS TIMESTAMP) + INTERVAL 1 DAY, CAST(MAX(date) AS TIMESTAMP) + INTERVAL 300 DAY,
             INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT code, date, value, value / NULLIF(LAG(value) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS x FROM exog_long)
      GROUP BY 1) WHERE isodow(d) < 6) WHERE step <= 126""", "exog_long"))
def _(spark, folder):
    aligned = cal.align_to_common(I.exog(spark, folder), "code", "value")
    return drift.exog_paths(aligned, 180, sigma_scale=0.0).select(
        "code", "step", "date", F.round(F.ln("value"), 8).alias("log_value"))


# ---- forecasts --------------------------------------------------------------
def ar_fits(spark, folder):
    return arima.forecast_all(I.panel(spark, folder), models=["arima"], steps=[7, 180, 365],
                              params={}, defaults=AR1)


# closed form: dy[T+k] = phi^k dy[T], so y[T+k] = y[T] + dy[T] (phi + ... + phi^k)
def _ar_parts(prefix: str) -> None:
    part(f"{prefix}ar_fit", """
  SELECT symbol, h, kind, phi, last_price, last_diff, last_date FROM (
    SELECT f.symbol, h, kind, SUM(x * l) FILTER (rn <= n - held) / SUM(l * l) FILTER (rn <= n - held) AS phi,
      arg_max(close, rn) FILTER (rn <= n - held) AS last_price, arg_max(x, rn) FILTER (rn <= n - held) AS last_diff,
      MAX(date) FILTER (rn <= n - held) AS last_date
    FROM (SELECT symbol, date, close, rn, n, diff AS x, LAG(diff) OVER (PARTITION BY symbol ORDER BY date) AS l FROM rets) f,
      (SELECT h, kind, CASE WHEN kind = 'future' THEN 0 ELSE h END AS held
       FROM (SELECT UNNEST([5, 126, 252]) AS h), (SELECT UNNEST(['backtest', 'future']) AS kind)) t
    GROUP BY 1, 2, 3)""".replace("rets", f"{prefix}rets"), f"{prefix}rets")
    part(f"{prefix}ar_points", """
  SELECT symbol, CASE h WHEN 5 THEN 7 WHEN 126 THEN 180 ELSE 365 END AS steps, h, kind, k AS step, last_price,
    last_price + last_diff * phi * (1 - POWER(phi, k)) / (1 - phi) AS price, date
  FROM (SELECT a.*, k, date FROM ar_fit a JOIN (
      SELECT symbol, 'backtest' AS kind, h, rn - (n - h) AS k, date FROM rets, (SELECT UNNEST([5, 126, 252]) AS h)
      WHERE rn > n - h
      UNION ALL
      SELECT symbol, 'future', h, k, d FROM (
        SELECT symbol, d, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY d) AS k FROM (
          SELECT symbol, CAST(UNNEST(generate_series(CAST(MAX(date) AS TIMESTAMP) + INTERVAL 1 DAY,
            CAST(MAX(date) AS TIMESTAMP) + INTERVAL 520 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM rets GROUP BY 1)
        WHERE isodow(d) < 6), (SELECT UNNEST([5, 126, 252]) AS h) WHERE k <= h) g
    ON g.symbol = a.symbol AND g.kind = a.kind AND g.h = a.h)""".replace("rets", f"{prefix}rets").replace("ar_fit", f"{prefix}ar_fit"),
         f"{prefix}ar_fit", f"{prefix}rets")


_ar_parts("")
_ar_parts("supplier_")


@query("forecast_ar", sql("""SELECT symbol, CAST(steps AS INTEGER) AS steps, kind, CAST(step AS INTEGER) AS step,
  date, ROUND(price, 3) AS price FROM ar_points""", "ar_points"))
def _(spark, folder):
    return arima.forecast_points(ar_fits(spark, folder)).select(
        "symbol", "steps", "kind", "step", "date", r("price", 3))


@query("forecast_ar_suppliers", sql("""SELECT symbol, CAST(steps AS INTEGER) AS steps, kind, CAST(step AS INTEGER) AS step,
  date, ROUND(price, 2) AS price FROM supplier_ar_points""", "supplier_ar_points"))
def _(spark, folder):
    """The same model for one series per supplier."""
    fits = arima.forecast_all(I.supplier_panel(spark, folder), models=["arima"],
                              steps=[7, 180, 365], params={}, defaults=AR1)
    return arima.forecast_points(fits).select(
        "symbol", "steps", "kind", "step", "date", r("price", 2))


part("supplier_choice", """
  SELECT symbol, n * LN((yy - ya * ya / aa) / n) + 2 < n * LN(yy / n) AS lagged FROM (
    SELECT symbol, COUNT(*) AS n, SUM(x * x) AS yy, SUM(x * l) AS ya, SUM(l * l) AS aa FROM (
      SELECT symbol, diff AS x, LAG(diff) OVER (PARTITION BY symbol ORDER BY date) AS l FROM supplier_rets)
    WHERE l IS NOT NULL GROUP BY 1)""", "supplier_rets")


@query("tuned_forecast_suppliers", sql("""SELECT symbol, CAST(steps AS INTEGER) AS steps, kind, CAST(step AS INTEGER) AS step,
  ROUND(CASE WHEN lagged THEN price ELSE last_price END, 2) AS price
  FROM supplier_ar_points JOIN supplier_choice USING (symbol)""", "supplier_ar_points", "supplier_choice"))
def _(spark, folder):
    """Order search and forecast in one job: the best order of each supplier reaches its fit as a row."""
    panel = I.supplier_panel(spark, folder)
    grid = [arima.Order(0, 1, 0), arima.Order(1, 1, 0)]
    fits = arima.forecast_all(panel, models=["arima"], steps=[7, 180, 365], grid=grid,
                              params=arima.tuned(panel, grid, ["arima"]), defaults=AR1)
    return arima.forecast_points(fits).select("symbol", "steps", "kind", "step", r("price", 2))


@query("backtest_points", sql("""SELECT a.symbol, CAST(steps AS INTEGER) AS steps, CAST(step AS INTEGER) AS step, a.date,
  ROUND(price, 3) AS price, ROUND(close, 6) AS actual
  FROM ar_points a JOIN panel p ON p.symbol = a.symbol AND p.date = a.date WHERE kind = 'backtest'""", "ar_points", "panel"))
def _(spark, folder):
    panel = I.panel(spark, folder)
    points = arima.forecast_points(ar_fits(spark, folder)).where(F.col("kind") == "backtest")
    return evaluate.with_actual(points.drop("actual"), panel).select(
        "symbol", "steps", "step", "date", r("price", 3), r("actual"))


_METRICS_SQL = """
  SELECT symbol, model, CAST(steps AS INTEGER) AS steps, COUNT(*) AS n, AVG(ABS(y - p)) AS mae, SQRT(AVG((y - p) * (y - p))) AS rmse,
    ROUND(200 * AVG(ABS(p - y) / (ABS(p) + ABS(y) + 1e-8)), 6) AS smape_pct, ROUND(100 * AVG(ABS((p - y) / (y + 1e-8))), 6) AS mape_pct,
    ROUND(AVG(ABS(ra - rp)), 8) AS mae_ret,
    ROUND(100 * AVG(CASE WHEN ra IS NULL OR rp IS NULL THEN NULL WHEN SIGN(CASE WHEN ABS(ra) < 1e-12 THEN 0 ELSE ra END) = SIGN(CASE WHEN ABS(rp) < 1e-12 THEN 0 ELSE rp END) THEN 1.0 ELSE 0.0 END), 6) AS dir_acc_pct,
    ROUND(100 * AVG(ABS(y / (b + 1e-8) - p / (b + 1e-8))), 6) AS mae_norm_pct
  FROM (SELECT symbol, model, steps, step, y, p, b,
      (y - LAG(y) OVER w) / (LAG(y) OVER w + 1e-8) AS ra, (p - LAG(p) OVER w) / (LAG(p) OVER w + 1e-8) AS rp
    FROM ({points}) WINDOW w AS (PARTITION BY symbol, model, steps ORDER BY step)) GROUP BY 1, 2, 3"""
_DRIFT_POINTS = """
  SELECT f.symbol, 'drift' AS model, steps, f.rn - (f.n - h) AS step, f.close AS y, b, b * POWER(1 + LEAST(GREATEST(mu, -c), c), f.rn - (f.n - h)) AS p
  FROM rets f JOIN (
    SELECT symbol, h, steps, c, AVG(ret) FILTER (rn <= n - h) AS mu, arg_max(close, rn) FILTER (rn <= n - h) AS b
    FROM rets, (VALUES (5, 7, 0.07::DOUBLE), (126, 180, 0.08::DOUBLE), (252, 365, 0.08::DOUBLE)) t(h, steps, c) GROUP BY 1, 2, 3, 4) g
  ON g.symbol = f.symbol AND f.rn > f.n - h"""
_AR_POINTS = """SELECT a.symbol, 'arima' AS model, steps, step, close AS y, last_price AS b, price AS p
  FROM ar_points a JOIN panel p ON p.symbol = a.symbol AND p.date = a.date WHERE kind = 'backtest'"""
_DIGITS = {"mae": 3, "rmse": 3, "smape_pct": 6, "mape_pct": 6, "mae_ret": 8, "dir_acc_pct": 6,
           "mae_norm_pct": 6}


def _rounded_metrics(df):
    return df.select("symbol", "model", "steps", "n", *[r(c, d) for c, d in _DIGITS.items()])


@query("forecast_drift", sql("""
  SELECT symbol, CAST(steps AS INTEGER) AS steps, CAST(step AS INTEGER) AS step, ROUND(LN(p), 8) AS log_price FROM (""" + _DRIFT_POINTS + ")",
    "rets"))
def _(spark, folder):
    fits = drift.drift_fits(I.panel(spark, folder), [7, 180, 365])
    return arima.forecast_points(fits).where(F.col("kind") == "backtest").select(
        "symbol", "steps", "step", F.round(F.ln("price"), 8).alias("log_price"))


@query("backtest_metrics", sql("SELECT * REPLACE (ROUND(mae, 3) AS mae, ROUND(rmse, 3) AS rmse) FROM ("
                               + _METRICS_SQL.format(points=_AR_POINTS) + ")", "ar_points", "panel"))
def _(spark, folder):
    points = arima.forecast_points(ar_fits(spark, folder)).where(F.col("kind") == "backtest")
    return _rounded_metrics(evaluate.backtest_metrics(points))


def _ar_and_drift(spark, folder):
    points = arima.forecast_points(ar_fits(spark, folder)).unionByName(
        arima.forecast_points(drift.drift_fits(I.panel(spark, folder), [7, 180, 365])))
    return evaluate.backtest_metrics(points.where(F.col("kind") == "backtest"))


@query("leaderboard", sql("""
  SELECT symbol, model, steps, ROUND(LN(mae), 6) AS log_mae, ROUND(LN(rmse), 6) AS log_rmse, CAST(ROW_NUMBER() OVER (PARTITION BY symbol, steps
    ORDER BY mae, model) AS INTEGER) AS place FROM (""" + _METRICS_SQL.format(
        points=_AR_POINTS + " UNION ALL " + _DRIFT_POINTS) + ")", "ar_points", "panel"))
def _(spark, folder):
    return evaluate.leaderboard(_ar_and_drift(spark, folder)).select(
        "symbol", "model", "steps", F.round(F.ln("mae"), 6).alias("log_mae"),
        F.round(F.ln("rmse"), 6).alias("log_rmse"), "place")


@query("metrics_pivot", sql("""
  SELECT symbol, model, ROUND(LN(MAX(rmse) FILTER (steps = 7)), 6) AS rmse_7, ROUND(LN(MAX(rmse) FILTER (steps = 180)), 6) AS rmse_180,
    ROUND(LN(MAX(rmse) FILTER (steps = 365)), 6) AS rmse_365 FROM (""" + _METRICS_SQL.format(
        points=_AR_POINTS + " UNION ALL " + _DRIFT_POINTS) + ") GROUP BY 1, 2", "ar_points", "panel"))
def _(spark, folder):
    wide = evaluate.metric_pivot(_ar_and_drift(spark, folder), "rmse", [7, 180, 365])
    return wide.select("symbol", "model", *[F.round(F.ln(c), 6).alias(c) for c in wide.columns[2:]])


@query("forecast_arx", sql("""
  , f AS (SELECT m.symbol, m.date, m.close, q.rn, q.n, diff AS y, LAG(diff) OVER w AS l, a - LAG(a) OVER w AS x
    FROM market m JOIN (SELECT symbol, date, rn, n, diff FROM rets) q ON q.symbol = m.symbol AND q.date = m.date
    WINDOW w AS (PARTITION BY m.symbol ORDER BY m.date)),
  s AS (SELECT symbol, SUM(l*l) AS ll, SUM(l*x) AS lx, SUM(x*x) AS xx, SUM(l*y) AS ly, SUM(x*y) AS xy
    FROM f WHERE l IS NOT NULL AND rn <= n - 5 GROUP BY 1),
  b AS (SELECT symbol, (ly*xx - xy*lx) / (ll*xx - lx*lx) AS phi, (xy*ll - ly*lx) / (ll*xx - lx*lx) AS beta FROM s)
  SELECT symbol, CAST(k AS INTEGER) AS step, ROUND(y0 + SUM(w) OVER (PARTITION BY symbol ORDER BY k), 2) AS price FROM (
    WITH RECURSIVE p(symbol, k, y0, w) AS (
      SELECT f.symbol, 0, close, y FROM f WHERE rn = n - 5
      UNION ALL
      SELECT p.symbol, p.k + 1, p.y0, b.phi * p.w + b.beta * f.x
      FROM p JOIN b ON b.symbol = p.symbol JOIN f ON f.symbol = p.symbol AND f.rn = f.n - 5 + p.k + 1)
    SELECT symbol, k, y0, CASE WHEN k = 0 THEN 0 ELSE w END AS w FROM p) QUALIFY k > 0""", "market", "rets"))
def _(spark, folder):
    """Order (1,1,0) with one exogenous column whose future is known."""
    panel = market_frame(spark, folder).select("symbol", "date", "close", "a")
    fits = arima.forecast_all(panel, models=["sarimax"], steps=[7], params={},
                              defaults={"sarimax": (1, 1, 0, 0, 0, 0, 0)}, exog=("a",),
                              exog_mode="actual", kinds=("backtest",))
    return arima.forecast_points(fits).select("symbol", "step", r("price", 2))


def _full_fits(spark, folder, steps=(7, 180, 365)):
    return arima.forecast_all(
        market_frame(spark, folder), models=["arima", "sarima", "sarimax"], steps=list(steps),
        params=PARAMS, exog=("a", "n", "r"))


@query("forecast_arima")
def _(spark, folder):
    fits = arima.forecast_all(I.panel(spark, folder), models=["arima"], steps=[7, 180, 365],
                              params=PARAMS)
    return arima.forecast_points(fits).select(
        "symbol", "steps", "kind", "step", "date", r("price", 2))


@query("forecast_seasonal")
def _(spark, folder):
    fits = arima.forecast_all(I.panel(spark, folder), models=["sarima"], steps=[7, 180, 365],
                              params=PARAMS)
    return arima.forecast_points(fits).select(
        "symbol", "steps", "kind", "step", "date", r("price", 2))


@query("forecast_exogenous")
def _(spark, folder):
    fits = arima.forecast_all(market_frame(spark, folder), models=["sarimax"],
                              steps=[7, 180, 365], params=PARAMS, exog=("a", "n", "r"))
    return arima.forecast_points(fits).select(
        "symbol", "steps", "kind", "step", "date", r("price", 2))


@query("forecast_status", sql("""
  SELECT symbol, model, CAST(steps AS INTEGER) AS steps, kind, 'ok' AS status, CASE WHEN kind = 'future' THEN n ELSE n - h END AS n_train
  FROM (SELECT symbol, COUNT(*) AS n FROM panel GROUP BY 1), (SELECT UNNEST(['arima','sarima','sarimax']) AS model),
    (VALUES (7, 5), (180, 126), (365, 252)) t(steps, h), (SELECT UNNEST(['backtest', 'future']) AS kind)""", "panel"))
def _(spark, folder):
    """Every key of the nightly grid with its status; no key stops another."""
    return _full_fits(spark, folder).select("symbol", "model", "steps", "kind", "status", "n_train")


@query("forecast_seasonal_ar", sql("""
  , f AS (SELECT symbol, rn, n, close, w, LAG(w, 5) OVER (PARTITION BY symbol ORDER BY rn) AS l
    FROM (SELECT symbol, rn, n, close, diff - LAG(diff, 5) OVER (PARTITION BY symbol ORDER BY date) AS w FROM rets)),
  b AS (SELECT symbol, SUM(w * l) / SUM(l * l) AS phi FROM f WHERE l IS NOT NULL GROUP BY 1),
  h AS (SELECT f.symbol, ANY_VALUE(phi) AS phi, list(close ORDER BY rn) AS y, list(w ORDER BY rn) AS w
    FROM f JOIN b ON b.symbol = f.symbol WHERE rn > n - 12 GROUP BY 1),
  p AS (
    SELECT symbol, phi, 0 AS k, y, w FROM h
    UNION ALL
    SELECT symbol, phi, k + 1, list_append(y, phi * w[len(w) - 4] + y[len(y)] + y[len(y) - 4] - y[len(y) - 5]),
      list_append(w, phi * w[len(w) - 4]) FROM p WHERE k < 5)
  SELECT symbol, CAST(k AS INTEGER) AS step, ROUND(y[len(y)], 2) AS price FROM p WHERE k > 0""", "rets", recursive=True))
def _(spark, folder):
    """Order (0,1,0)(1,1,0,5): one seasonal lag, forecast for the next week."""
    fits = arima.forecast_all(I.panel(spark, folder), models=["sarima"], steps=[7], kinds=("future",),
                              params={}, defaults={"sarima": (0, 1, 0, 1, 1, 0, 20)})
    return arima.forecast_points(fits).select("symbol", "step", r("price", 2))


LAB = {"arima": (2, 1, 0, 0, 0, 0, 0), "sarima": (2, 1, 0, 1, 1, 0, 12)}  # fixed values


@query("arima_vs_sarima")
def _(spark, folder):
    """15 held-out steps, seasonal period 12: RMSE and MAPE side by side."""
    fits = arima.forecast_all(I.panel(spark, folder), models=["arima", "sarima"], steps=[15],
                              kinds=("backtest",), params={}, defaults=LAB, season=12)
    metrics = evaluate.backtest_metrics(arima.forecast_points(fits))
    rmse = evaluate.horizon_table(metrics, ["arima", "sarima"], "rmse")
    mape = evaluate.horizon_table(metrics, ["arima", "sarima"], "mape_pct")
    out = rmse.join(mape, ["symbol", "steps"])
    return out.select("symbol", *[r(c, 4) for c in out.columns[2:]])


MATRIX = {"arima": (0, 1, 0, 0, 0, 0, 0), "sarima": (1, 1, 1, 1, 1, 0, 12),
          "sarimax": (1, 1, 1, 1, 0, 1, 12)}  # fixed values


def matrix_metrics(spark, folder):
    """The short model sees 6 months, the others 3 years; a horizon longer than the
    history gives an error row and no metrics."""
    steps = [7, 180, 365]
    market = market_frame(spark, folder).select("symbol", "date", "close", "a")
    near = arima.forecast_all(
        roll.period_slice(market, "6mo"), models=["arima"], steps=steps, kinds=("backtest",),
        params={}, defaults=MATRIX)
    far = arima.forecast_all(
        roll.period_slice(market, "3y"), models=["sarima", "sarimax"], steps=steps,
        kinds=("backtest",), params={}, defaults=MATRIX, season=12, exog=("a",), exog_mode="actual")
    points = arima.forecast_points(near).unionByName(arima.forecast_points(far))
    return evaluate.backtest_metrics(points)


@query("backtest_matrix")
def _(spark, folder):
    metrics = matrix_metrics(spark, folder)
    models = ["arima", "sarima", "sarimax"]
    wide = evaluate.horizon_table(metrics, models, "rmse").join(
        evaluate.horizon_table(metrics, models, "mae"), ["symbol", "steps"])
    return wide.select("symbol", "steps", *[r(c, 4) for c in wide.columns[2:]])


@query("experiment_log", sql("""
  SELECT symbol AS ticker, CAST(steps AS VARCHAR) AS steps, model, symbol || '_' || steps || '_' || model || '_batch-1' AS run_id,
    ROUND(mape_pct / 100, 2) AS mape_ratio FROM (""" + _METRICS_SQL.format(
        points=_AR_POINTS + " UNION ALL " + _DRIFT_POINTS) + ")", "ar_points", "panel"))
def _(spark, folder):
    """Metrics of a run appended to the log in its fixed columns, read back."""
    from tidepanel.session import fresh_path
    from tidepanel.sources.writers import append_metrics

    metrics = _ar_and_drift(spark, folder)
    path = fresh_path(spark, "experiments")
    append_metrics(evaluate.experiment_rows(metrics, "batch-1", notes="nightly"), path,
                   "2024-01-01 00:00:00")
    log = spark.read.option("header", "true").csv(path)
    mape = F.col("`MAPE%`").cast("double")
    return log.select(
        "ticker", "steps", "model", "run_id", F.round(mape / 100, 2).alias("mape_ratio"))


@query("model_leaderboard")
def _(spark, folder):
    """Three regression models and the drift floor, ranked per series and horizon."""
    steps = [7, 180, 365]
    points = arima.forecast_points(_full_fits(spark, folder)).unionByName(
        arima.forecast_points(drift.drift_fits(I.panel(spark, folder), steps)))
    metrics = evaluate.backtest_metrics(points.where(F.col("kind") == "backtest"))
    return evaluate.leaderboard(metrics).select(
        "symbol", "model", "steps", "place", "n", *[r(c, d) for c, d in _DIGITS.items()])


# ---- order search -----------------------------------------------------------
part("ar_sums", """
  SELECT symbol, d, COUNT(*) AS n, SUM(y) AS sy, SUM(a) AS sa, SUM(b) AS sb, SUM(y*y) AS yy, SUM(y*a) AS ya, SUM(y*b) AS yb,
    SUM(a*a) AS aa, SUM(a*b) AS ab, SUM(b*b) AS bb
  FROM (SELECT symbol, d, y, LAG(y) OVER w AS a, LAG(y, 2) OVER w AS b FROM (
      SELECT symbol, date, 0 AS d, close / 1000 AS y FROM rets UNION ALL SELECT symbol, date, 1, diff / 1000 FROM rets WHERE diff IS NOT NULL)
    WINDOW w AS (PARTITION BY symbol, d ORDER BY date)) WHERE b IS NOT NULL GROUP BY 1, 2""", "rets")
part("ar_aic", """
  SELECT symbol, CAST(p AS INTEGER) AS p, CAST(d AS INTEGER) AS d, n, n * LN(rss / n) + 2 * (p + 1 - d) AS aic FROM (
    SELECT symbol, d, n, p, CASE p WHEN 0 THEN cyy WHEN 1 THEN cyy - cya * cya / caa
      ELSE cyy - (cya * (cya * cbb - cyb * cab) + cyb * (cyb * caa - cya * cab)) / (caa * cbb - cab * cab) END AS rss
    FROM (SELECT symbol, d, n, yy - u * sy * sy / n AS cyy, ya - u * sy * sa / n AS cya, yb - u * sy * sb / n AS cyb,
        aa - u * sa * sa / n AS caa, ab - u * sa * sb / n AS cab, bb - u * sb * sb / n AS cbb
      FROM (SELECT *, 1 - d AS u FROM ar_sums)), (SELECT UNNEST([0, 1, 2]) AS p))""", "ar_sums")
AR_GRID = [arima.Order(p, d, 0) for p in range(3) for d in range(2)]


def _scaled_panel(spark, folder):
    return I.panel(spark, folder).withColumn("close", F.col("close") / 1000)


@query("order_search", sql("""
  SELECT symbol, p, d, 0::INTEGER AS q, n AS n_used, ROUND(aic, 4) AS aic,
    ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY aic, p, d) = 1 AS best FROM ar_aic""", "ar_aic"))
def _(spark, folder):
    from pyspark.sql import Window as W

    scores = arima.order_search(_scaled_panel(spark, folder), AR_GRID)
    best = F.row_number().over(W.partitionBy("symbol").orderBy("aic", "rank")) == 1
    return scores.select("symbol", "p", "d", "q", "n_used", r("aic", 4), best.alias("best"))


@query("global_order", sql("""
  , best AS (SELECT * FROM ar_aic QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY aic, p, d) = 1),
  s AS (SELECT p, d, SUM(aic) AS aic_sum, COUNT(*) AS series, MIN(symbol) AS fs FROM best GROUP BY 1, 2)
  SELECT p, d, ROUND(aic_sum, 3) AS aic_sum, series,
    ROW_NUMBER() OVER (ORDER BY aic_sum, fs) = 1 AS by_sum, ROW_NUMBER() OVER (ORDER BY series DESC, fs) = 1 AS by_mode FROM s""",
    "ar_aic"))
def _(spark, folder):
    best = arima.best_orders(arima.order_search(_scaled_panel(spark, folder), AR_GRID))
    return arima.global_order(best).select(
        "p", "d", r("aic_sum", 3), "series", "by_sum", "by_mode")


@query("order_search_arima")
def _(spark, folder):
    return arima.order_search(_scaled_panel(spark, folder), arima.ARIMA_GRID).select(
        "symbol", "p", "d", "q", "n_used", r("aic", 3))


@query("order_search_seasonal")
def _(spark, folder):
    return arima.best_orders(
        arima.order_search(_scaled_panel(spark, folder), arima.SEASONAL_GRID)
    ).select("symbol", "p", "d", "q", "sp", "sd",
             "sq", "m", r("aic", 3))


@query("order_search_exogenous")
def _(spark, folder):
    panel = market_frame(spark, folder).select("symbol", "date", "close", "a")
    return arima.best_orders(arima.order_search(panel, arima.SEASONAL_GRID, ("a",))).select(
        "symbol", "p", "d", "q", "sp", "sd",
        "sq", "m", r("aic", 3))


# ---- learned model ----------------------------------------------------------
def _feature_panel(spark, folder):
    """Prices with their indicators; the indicators are kept as levels."""
    from tidepanel.operators.indicators import indicator_matrix

    return indicator_matrix(I.panel(spark, folder))


def learned(spark, folder, steps):
    from tidepanel.operators.indicators import indicator_names
    from tidepanel.plans.learned import learned_fits

    return learned_fits(_feature_panel(spark, folder), steps, indicator_names())


@query("forecast_learned")
def _(spark, folder):
    """One global windowed model: recursive for 7 days, blocks for 180 and 365."""
    return arima.forecast_points(learned(spark, folder, [7, 180, 365])).select(
        "symbol", "steps", "kind", "step", "date", r("price", 2))


@query("forecast_learned_exogenous")
def _(spark, folder):
    """The same model with the returns of three exogenous series over the whole look-back."""
    from tidepanel.plans import nightly

    fits = nightly.forecast(market_frame(spark, folder), ["lstm"], [7, 180])
    return arima.forecast_points(fits).select("symbol", "steps", "kind", "step", "date", r("price", 2))
