"""Alignment, exogenous joins, slices, returns and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.dates import next_business_days, to_zone
from tidepanel.functions import scalars as X
from tidepanel.operators import calendar as cal, indicators as ind, market, rolling as roll
from tidepanel.sources import readers
from workload import inputs as I
from workload.registry import part, query, sql


def r(name, digits=6):
    """Half away from zero on doubles, as the comparison engine rounds; stays in
    generated code, which decimal rounding would leave."""
    x, scale = F.col(name), float(10**digits)
    # adding 0 turns a negative zero into zero
    return (F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)).alias(name)


def mean_r(name):
    """Means of cents often end in an exact 5; the offset settles such ties upwards."""
    return F.round(F.col(name) + 1e-8, 6).alias(name)


@query("panel_align", sql("SELECT symbol, date, ROUND(close, 6) AS close FROM ensured", "ensured"))
def _(spark, folder):
    return cal.ensure_business_days(I.prices(spark, folder)).select("symbol", "date", r("close"))


@query("panel_backfill", sql("SELECT symbol, date, ROUND(close, 6) AS close FROM panel", "panel"))
def _(spark, folder):
    return cal.ingest_prices(I.prices(spark, folder)).select("symbol", "date", r("close"))


@query("panel_align_suppliers", sql(
    "SELECT symbol, date, ROUND(close, 6) AS close FROM supplier_panel", "supplier_panel"))
def _(spark, folder):
    return I.supplier_panel(spark, folder).select("symbol", "date", r("close"))


@query("panel_asof_union", sql("""
  SELECT symbol, date, ROUND(COALESCE(LAST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    FIRST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 6) AS close
  FROM (SELECT s.symbol, d.date, p.close AS c
        FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT symbol FROM prices) s
        LEFT JOIN prices p ON p.symbol = s.symbol AND p.date = d.date)""", "prices"))
def _(spark, folder):
    return cal.align_to_union(I.prices(spark, folder)).select("symbol", "date", r("close"))


@query("exog_wide", sql(
    "SELECT date, ROUND(a, 6) AS a, ROUND(n, 6) AS n, ROUND(r, 6) AS r FROM exog_wide", "exog_wide"))
def _(spark, folder):
    return market.exog_wide(I.exog(spark, folder), I.EXOG_CODES).select("date", r("a"), r("n"), r("r"))


def market_frame(spark, folder):
    wide = market.exog_wide(I.exog(spark, folder), I.EXOG_CODES)
    return market.market_table(cal.ingest_prices(I.prices(spark, folder)), wide)


part("market", """
  SELECT p.date, p.symbol, p.close, COALESCE(a, 0) AS a, COALESCE(n, 0) AS n, COALESCE(r, 0) AS r
  FROM panel p LEFT JOIN exog_wide e ON e.date = p.date""", "panel", "exog_wide")


@query("market_join", sql("""SELECT date, symbol, ROUND(close, 6) AS close, ROUND(a, 6) AS a,
  ROUND(n, 6) AS n, ROUND(r, 6) AS r FROM market""", "market"))
def _(spark, folder):
    return market_frame(spark, folder).select(
        "date", "symbol", r("close"), r("a"), r("n"), r("r"))


@query("exog_on_series", sql("""
  SELECT symbol, date, ROUND(v, 6) AS n FROM (
    SELECT p.symbol, p.date, COALESCE(LAST_VALUE(e.n IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      FIRST_VALUE(e.n IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS v
    FROM panel p LEFT JOIN exog_wide e ON e.date = p.date AND e.n > e.a)""", "panel", "exog_wide"))
def _(spark, folder):
    wide = market.exog_wide(I.exog(spark, folder), I.EXOG_CODES)
    sparse = wide.where(F.col("n") > F.col("a")).select("date", "n")
    return market.exog_on_series(I.panel(spark, folder), sparse).select("symbol", "date", r("n"))


@query("exog_returns", sql("""
  SELECT symbol, date, ROUND(LAST_VALUE(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ex_a
  FROM (SELECT symbol, date, a / NULLIF(LAG(a) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS x,
          ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM market)
  QUALIFY LAST_VALUE(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL""", "market"))
def _(spark, folder):
    return market.exog_returns(market_frame(spark, folder), ["a"]).select(
        "symbol", "date", r("ex_a"))


@query("exog_on_price_dates", sql("""
  SELECT code, date, ROUND(value, 6) AS value FROM exog
  WHERE date IN (SELECT date FROM prices)""", "exog", "prices"))
def _(spark, folder):
    return market.on_series_dates(I.exog(spark, folder), I.prices(spark, folder)).select(
        "code", "date", r("value"))


@query("symbol_lookup", sql("""SELECT symbol, date, ROUND(close, 6) AS close FROM prices
  WHERE LOWER(symbol) = LOWER('2-high')""", "prices"))
def _(spark, folder):
    return readers.market_symbol(I.prices(spark, folder), "2-high").select(
        "symbol", "date", r("close"))


@query("dated_returns", sql("""
  SELECT symbol, date, ROUND(close, 6) AS close,
    ROUND(close / NULLIF(LAG(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1, 6) AS ret
  FROM prices WHERE date >= DATE '1997-01-01' AND date < DATE '1999-01-01'""", "prices"))
def _(spark, folder):
    cut = readers.between_dates(I.prices(spark, folder), "1997-01-01", "1999-01-01")
    return cut.withColumn("ret", roll.pct_change("close")).select(
        "symbol", "date", r("close"), r("ret"))


@query("period_slice", sql("""
  SELECT p.symbol, p.date, ROUND(p.close, 6) AS close
  FROM panel p JOIN (SELECT symbol, MAX(date) AS hi FROM panel GROUP BY 1) b USING (symbol)
  WHERE p.date > CAST(b.hi - INTERVAL 6 MONTH AS DATE)""", "panel"))
def _(spark, folder):
    return roll.period_slice(I.panel(spark, folder), "6mo").select("symbol", "date", r("close"))


@query("calendar_ranges", sql("""
  SELECT symbol, '1mo' AS range, COUNT(*) AS n, MIN(date) AS first_day FROM panel JOIN b USING (symbol)
  WHERE date >= CAST(hi - INTERVAL 1 MONTH AS DATE) GROUP BY 1
  UNION ALL SELECT symbol, '6mo', COUNT(*), MIN(date) FROM panel JOIN b USING (symbol)
  WHERE date >= CAST(hi - INTERVAL 6 MONTH AS DATE) GROUP BY 1
  UNION ALL SELECT symbol, 'ytd', COUNT(*), MIN(date) FROM panel JOIN b USING (symbol)
  WHERE date >= date_trunc('year', hi) GROUP BY 1""".replace(
      "JOIN b USING (symbol)",
      "JOIN (SELECT symbol, MAX(date) AS hi FROM panel GROUP BY 1) b USING (symbol)"), "panel"))
def _(spark, folder):
    base = I.panel(spark, folder)
    parts = [
        roll.calendar_range(base, name).groupBy("symbol").agg(
            F.count("*").alias("n"), F.min("date").alias("first_day")
        ).select("symbol", F.lit(name).alias("range"), "n", "first_day")
        for name in ("1mo", "6mo", "ytd")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("trailing_days", sql("""
  SELECT symbol, date, ROUND(close, 6) AS close FROM panel
  QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) <= 126""", "panel"))
def _(spark, folder):
    return roll.trading_range(I.panel(spark, folder), "6mo").select("symbol", "date", r("close"))


@query("ytd_slice", sql("""
  SELECT symbol, date, ROUND(close, 6) AS close FROM panel WHERE date >= DATE '2001-01-01'""", "panel"))
def _(spark, folder):
    as_of = F.lit("2001-08-02").cast("date")
    return roll.year_to_date(I.panel(spark, folder), as_of).select("symbol", "date", r("close"))


@query("returns", sql("SELECT symbol, date, ROUND(ret, 9) AS ret FROM rets", "rets"))
def _(spark, folder):
    return I.returns(spark, folder).select("symbol", "date", r("ret", 9))


@query("log_returns", sql("SELECT symbol, date, ROUND(log_ret, 9) AS log_ret FROM rets", "rets"))
def _(spark, folder):
    return I.returns(spark, folder).select("symbol", "date", r("log_ret", 9))


@query("differences", sql("SELECT symbol, date, ROUND(diff, 5) AS diff FROM rets", "rets"))
def _(spark, folder):
    return I.returns(spark, folder).select("symbol", "date", r("diff", 5))


@query("seasonal_diff", sql("""
  SELECT symbol, date, ROUND(close - LAG(close, 20) OVER (PARTITION BY symbol ORDER BY date), 5) AS seasonal_diff
  FROM panel""", "panel"))
def _(spark, folder):
    return roll.seasonal_difference(I.panel(spark, folder), 20).select(
        "symbol", "date", r("seasonal_diff", 5))


def _ma_sql(source: str) -> str:
    return f"""
  SELECT symbol, date,
    CASE WHEN rn >= 50 THEN ROUND(AVG(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) + 1e-8, 6) END AS ma50,
    CASE WHEN rn >= 200 THEN ROUND(AVG(close) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) + 1e-8, 6) END AS ma200
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM {source})
  WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


@query("moving_averages", sql(_ma_sql("panel"), "panel"))
def _(spark, folder):
    return roll.moving_averages(I.panel(spark, folder)).select(
        "symbol", "date", mean_r("ma50"), mean_r("ma200"))


@query("moving_averages_suppliers", sql(_ma_sql("supplier_panel"), "supplier_panel"))
def _(spark, folder):
    return roll.moving_averages(I.supplier_panel(spark, folder)).select(
        "symbol", "date", mean_r("ma50"), mean_r("ma200"))


@query("rolling_volatility", sql("""
  SELECT symbol, date, ROUND(COALESCE(sd, 0), 8) AS vol_any,
    CASE WHEN rn > 20 THEN ROUND(sd * 100, 6) END AS vol_pct,
    CASE WHEN rn > 20 THEN ROUND(sd * SQRT(20) * 100, 6) END AS vol_scaled_pct
  FROM (SELECT symbol, date, rn, STDDEV_SAMP(ret) OVER (PARTITION BY symbol ORDER BY date
          ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd FROM rets)""", "rets"))
def _(spark, folder):
    return roll.rolling_volatility(I.panel(spark, folder)).select(
        "symbol", "date", r("vol_any", 8), r("vol_pct"), r("vol_scaled_pct"))


@query("level_volatility", sql("""
  SELECT symbol, date, CASE WHEN rn >= 20 THEN ROUND(STDDEV_POP(close) OVER (PARTITION BY symbol
    ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) END AS level_vol FROM rets""", "rets"))
def _(spark, folder):
    return roll.level_volatility(I.panel(spark, folder)).select(
        "symbol", "date", r("level_vol", 4))


# ---- recursive means: one row of state per step in the SQL twin -------------
def _ewm_parts(prefix: str, rets: str) -> None:
    part(f"{prefix}ewm", f"""
  SELECT symbol, date, rn, close, GREATEST(COALESCE(diff, 0), 0) AS gain,
         GREATEST(-COALESCE(diff, 0), 0) AS loss FROM {rets}""", rets)
    text = """
  SELECT symbol, date, rn, close, close AS e10, close AS e50, gain AS up, loss AS down,
         close AS e12, close AS e26, CAST(0 AS DOUBLE) AS macd, CAST(0 AS DOUBLE) AS sig
  FROM ewm WHERE rn = 1
  UNION ALL
  SELECT x.symbol, x.date, x.rn, x.close,
    r.e10 * (1 - 2.0::DOUBLE/11) + x.close * (2.0::DOUBLE/11), r.e50 * (1 - 2.0::DOUBLE/51) + x.close * (2.0::DOUBLE/51),
    r.up * (1 - 1.0::DOUBLE/14) + x.gain * (1.0::DOUBLE/14), r.down * (1 - 1.0::DOUBLE/14) + x.loss * (1.0::DOUBLE/14),
    r.e12 * (1 - 2.0::DOUBLE/13) + x.close * (2.0::DOUBLE/13), r.e26 * (1 - 2.0::DOUBLE/27) + x.close * (2.0::DOUBLE/27),
    (r.e12 * (1 - 2.0::DOUBLE/13) + x.close * (2.0::DOUBLE/13)) - (r.e26 * (1 - 2.0::DOUBLE/27) + x.close * (2.0::DOUBLE/27)),
    r.sig * 0.8::DOUBLE + ((r.e12 * (1 - 2.0::DOUBLE/13) + x.close * (2.0::DOUBLE/13))
      - (r.e26 * (1 - 2.0::DOUBLE/27) + x.close * (2.0::DOUBLE/27))) * 0.2::DOUBLE
  FROM ewm_run r JOIN ewm x ON x.symbol = r.symbol AND x.rn = r.rn + 1"""
    part(f"{prefix}ewm_run", text.replace("ewm", f"{prefix}ewm"), f"{prefix}ewm")


_ewm_parts("", "rets")
_ewm_parts("supplier_", "supplier_rets")


def _ewm_sql(body):
    return sql(body, "ewm_run", recursive=True)


@query("ema", _ewm_sql("SELECT symbol, date, ROUND(e10, 4) AS ema10, ROUND(e50, 4) AS ema50 FROM ewm_run"))
def _(spark, folder):
    return ind.ema(I.panel(spark, folder)).select("symbol", "date", r("ema10", 4), r("ema50", 4))


RSI_SQL = "CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END"


@query("rsi", _ewm_sql(f"""SELECT symbol, date, ROUND({RSI_SQL}, 6) AS rsi14,
  CASE WHEN rn >= 14 THEN ROUND({RSI_SQL}, 6) END AS rsi14_strict FROM ewm_run"""))
def _(spark, folder):
    filled = ind.rsi(I.panel(spark, folder))
    strict = F.when(F.row_number().over(cal.series()) >= 14, F.col("rsi14"))
    return filled.withColumn("rsi14_strict", strict).select(
        "symbol", "date", r("rsi14"), r("rsi14_strict"))


@query("macd", _ewm_sql(
    "SELECT symbol, date, ROUND(macd, 4) + 0::DOUBLE AS macd, ROUND(sig, 4) + 0::DOUBLE AS macd_signal FROM ewm_run"))
def _(spark, folder):
    return ind.macd(I.panel(spark, folder)).select(
        "symbol", "date", r("macd", 4), r("macd_signal", 4))


@query("macd_strict", _ewm_sql("""SELECT symbol, date, CASE WHEN rn >= 26 THEN ROUND(macd, 4) + 0::DOUBLE END AS macd,
  CASE WHEN rn >= 34 THEN ROUND(sig, 4) + 0::DOUBLE END AS macd_signal FROM ewm_run"""))
def _(spark, folder):
    """Null until the slow mean, and the signal on it, have their rows."""
    return ind.macd(I.panel(spark, folder), strict=True).select(
        "symbol", "date", r("macd", 4), r("macd_signal", 4))


@query("rsi_strict", _ewm_sql(f"SELECT symbol, date, CASE WHEN rn >= 14 THEN ROUND({RSI_SQL}, 6) END AS rsi14 FROM ewm_run"))
def _(spark, folder):
    return ind.rsi(I.panel(spark, folder), strict=True).select("symbol", "date", r("rsi14"))


@query("bollinger_strict", sql("""
  SELECT symbol, date, CASE WHEN k >= 20 THEN ROUND(m - 2 * s, 4) END AS bb_low, CASE WHEN k >= 20 THEN ROUND(m + 2 * s, 4) END AS bb_high,
    CASE WHEN k >= 20 AND s > 1e-10 * ABS(m) THEN ROUND((close - (m - 2 * s)) / (4 * s), 6) + 0::DOUBLE END AS bb_pct
  FROM (SELECT symbol, date, close, AVG(close) OVER w AS m, STDDEV_POP(close) OVER w AS s, COUNT(close) OVER w AS k FROM panel
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  """, "panel"))
def _(spark, folder):
    return ind.bollinger(I.panel(spark, folder), strict=True).select(
        "symbol", "date", r("bb_low", 4), r("bb_high", 4), r("bb_pct"))


@query("bollinger", sql("""
  SELECT symbol, date, ROUND(m - 2 * s, 4) AS bb_low, ROUND(m + 2 * s, 4) AS bb_high,
    ROUND(CASE WHEN s <= 1e-10 * ABS(m) THEN 0 ELSE (close - (m - 2 * s)) / (4 * s + 1e-9) END, 6) + 0::DOUBLE AS bb_pct
  FROM (SELECT symbol, date, close, AVG(close) OVER w AS m, STDDEV_POP(close) OVER w AS s FROM panel
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  """, "panel"))
def _(spark, folder):
    return ind.bollinger(I.panel(spark, folder)).select(
        "symbol", "date", r("bb_low", 4), r("bb_high", 4), r("bb_pct"))


def _matrix_sql(prefix: str) -> str:
    return sql(f"""
  SELECT e.symbol, e.date, ROUND(e10, 4) AS ind_ema10, ROUND(e50, 4) AS ind_ema50,
    ROUND({RSI_SQL}, 6) AS ind_rsi14, ROUND(macd, 4) + 0::DOUBLE AS ind_macd, ROUND(sig, 4) + 0::DOUBLE AS ind_macd_signal,
    ROUND(bbp, 6) + 0::DOUBLE AS ind_bbp, ROUND(COALESCE(vol, 0), 8) AS ind_vol20
  FROM {prefix}ewm_run e JOIN (
    SELECT symbol, date, CASE WHEN STDDEV_POP(close) OVER w <= 1e-10 * ABS(AVG(close) OVER w) THEN 0
        ELSE (close - (AVG(close) OVER w - 2 * STDDEV_POP(close) OVER w))
        / (4 * STDDEV_POP(close) OVER w + 1e-9) END AS bbp, STDDEV_SAMP(ret) OVER w AS vol
    FROM {prefix}rets WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) b
    ON b.symbol = e.symbol AND b.date = e.date""", f"{prefix}ewm_run", recursive=True)


@query("indicator_matrix", _matrix_sql(""))
def _(spark, folder):
    digits = {"ind_rsi14": 6, "ind_bbp": 6, "ind_vol20": 8}
    return ind.indicator_matrix(I.panel(spark, folder)).select(
        "symbol", "date", *[r(c, digits.get(c, 4)) for c in ind.indicator_names()])


@query("indicator_matrix_suppliers", _matrix_sql("supplier_"))
def _(spark, folder):
    """The same indicators over one series per supplier."""
    digits = {"ind_rsi14": 6, "ind_bbp": 6, "ind_vol20": 8}
    return ind.indicator_matrix(I.supplier_panel(spark, folder)).select(
        "symbol", "date", *[r(c, digits.get(c, 4)) for c in ind.indicator_names()])


@query("future_index", sql("""
  SELECT symbol, h AS horizon, k AS step, date FROM (
    SELECT symbol, h, d AS date, ROW_NUMBER() OVER (PARTITION BY symbol, h ORDER BY d) AS k
    FROM (SELECT symbol, h, CAST(UNNEST(generate_series(CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY,
            CAST(hi AS TIMESTAMP) + INTERVAL 520 DAY, INTERVAL 1 DAY)) AS DATE) AS d
          FROM (SELECT symbol, MAX(date) AS hi FROM panel GROUP BY 1),
               (SELECT UNNEST([5, 126, 252]) AS h))
    WHERE isodow(d) < 6) WHERE k <= h""", "panel"))
def _(spark, folder):
    last = I.panel(spark, folder).groupBy("symbol").agg(F.max("date").alias("last"))
    horizons = F.array(F.lit(5), F.lit(126), F.lit(252))
    return (
        last.select("symbol", "last", F.explode(horizons).alias("horizon"))
        .select("symbol", "horizon", F.posexplode(next_business_days("last", F.col("horizon"))))
        .select("symbol", "horizon", (F.col("pos") + 1).cast("long").alias("step"),
                F.col("col").alias("date"))
    )


@query("scalar_formats", sql("""
  SELECT symbol, date, strftime(date, '%Y-%m-%d') AS iso, strftime(date, '%d/%m/%Y') AS dmy,
    strftime(CAST(date AS TIMESTAMP) + INTERVAL 90061 SECOND, '%H:%M:%S %Y-%m-%d') AS clock,
    LOWER(REPLACE(REPLACE(REPLACE(symbol, '-', '_'), ' ', '_'), '/', '_')) AS safe_name,
    UPPER(TRIM(' ' || symbol || ' ')) AS upper_name, string_split(symbol, '-')[2] AS tail,
    CASE symbol WHEN '1-URGENT' THEN 'NASDAQ' WHEN '2-HIGH' THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
    CAST(isodow(date) - 1 AS INTEGER) AS weekday,
    strftime(CAST(date AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Bangkok', '%H:%M') AS local_clock,
    CASE WHEN ret IS NOT NULL THEN ROUND(LEAST(GREATEST(ret, -0.07), 0.07), 8) END AS clipped, SIGN(COALESCE(diff, 0)) AS sign,
    ROUND(EXP(LN(1 + ABS(ret))) - 1, 8) AS expm1_abs, ROUND(SQRT(close), 6) AS root
  FROM rets""", "rets"))
def _(spark, folder):
    ts = F.col("date").cast("timestamp_ntz")
    return I.returns(spark, folder).select(
        "symbol", "date",
        F.date_format("date", "yyyy-MM-dd").alias("iso"),
        F.date_format("date", "dd/MM/yyyy").alias("dmy"),
        F.date_format(ts + F.make_dt_interval(F.lit(1), F.lit(1), F.lit(1), F.lit(1)),
                      "HH:mm:ss yyyy-MM-dd").alias("clock"),
        X.safe_name_col("symbol").alias("safe_name"),
        F.upper(F.trim(F.concat(F.lit(" "), "symbol", F.lit(" ")))).alias("upper_name"),
        F.get(F.split("symbol", "-"), F.lit(1)).alias("tail"),
        X.map_lookup("symbol", {"1-URGENT": "NASDAQ", "2-HIGH": "NYSE"}, "NASDAQ").alias("exchange"),
        F.weekday("date").alias("weekday"),
        F.date_format(to_zone(ts, "Asia/Bangkok"), "HH:mm").alias("local_clock"),
        F.round(X.clip("ret", 0.07), 8).alias("clipped"),
        F.signum(F.coalesce("diff", F.lit(0.0))).cast("int").alias("sign"),
        F.round(F.expm1(F.log1p(F.abs("ret"))), 8).alias("expm1_abs"),
        F.round(F.sqrt("close"), 6).alias("root"),
    )


@query("null_policy", sql("""
  SELECT symbol, COUNT(*) AS rows, COUNT(ret) AS with_return,
    SUM(CASE WHEN ret IS NULL AND diff IS NULL THEN 1 ELSE 0 END)::BIGINT AS all_missing,
    ROUND(SUM(COALESCE(ret, 0)), 6) AS filled_sum FROM rets GROUP BY 1""", "rets"))
def _(spark, folder):
    base = I.returns(spark, folder).withColumn("ret", X.finite("ret"))
    return base.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.count("ret").alias("with_return"),
        F.sum((F.col("ret").isNull() & F.col("diff").isNull()).cast("long")).alias("all_missing"),
        F.round(F.sum(X.number_or("ret")), 6).alias("filled_sum"))


SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SHORT = ["urgent", "high", "medium", "open", "low"]


@query("wide_close", sql("SELECT date, " + ", ".join(
    f"ROUND(MAX(close) FILTER (symbol = '{s}'), 6) AS {n}" for s, n in zip(SYMBOLS, _SHORT))
    + " FROM prices GROUP BY 1", "prices"))
def _(spark, folder):
    wide = readers.wide_close(I.prices(spark, folder), SYMBOLS).toDF("date", *_SHORT)
    return wide.select("date", *[r(n) for n in _SHORT])


@query("stored_market", sql("""SELECT symbol, COUNT(*) AS n, MIN(date) AS lo, MAX(date) AS hi,
  ROUND(SUM(close), 2) AS total FROM market WHERE symbol = '5-LOW' GROUP BY 1""", "market"))
def _(spark, folder):
    """Write the market table, read one symbol back."""
    from tidepanel.session import fresh_path
    from tidepanel.sources.writers import write_market

    path = fresh_path(spark, "market")
    write_market(market_frame(spark, folder), path)
    back = readers.read_symbol(spark, path, "5-low")
    return back.groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.round(F.sum("close"), 2).alias("total"))


@query("stored_period", sql("""
  SELECT p.symbol, COUNT(*) AS n, MIN(p.date) AS lo, MAX(p.date) AS hi, ROUND(MIN(p.close), 4) AS least, ROUND(MAX(p.close), 4) AS most
  FROM supplier_panel p JOIN (SELECT symbol, MAX(date) AS hi FROM supplier_panel GROUP BY 1) b USING (symbol)
  WHERE p.date > CAST(b.hi - INTERVAL 6 MONTH AS DATE) GROUP BY 1""", "supplier_panel"))
def _(spark, folder):
    """Write the market table of all suppliers, read the last six months of each series back."""
    from tidepanel.session import fresh_path
    from tidepanel.sources.writers import write_market

    path = fresh_path(spark, "market")
    write_market(I.supplier_panel(spark, folder), path)
    return readers.read_period(spark, path, "6mo").groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.round(F.min("close"), 4).alias("least"), F.round(F.max("close"), 4).alias("most"))


@query("stored_symbols", sql("""SELECT symbol, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS n FROM supplier_panel GROUP BY 1""",
       "supplier_panel"))
def _(spark, folder):
    """The table of ends beside a stored market table."""
    from tidepanel.session import fresh_path
    from tidepanel.sources.writers import ends_path, write_market

    path = fresh_path(spark, "market")
    write_market(I.supplier_panel(spark, folder), path)
    return spark.read.parquet(ends_path(path))
