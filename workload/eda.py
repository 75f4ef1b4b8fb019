"""Descriptive statistics, outliers, correlation, decomposition and unit roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import (correlation, decompose, rolling as roll, samples, stats,
                                 unitroot)
from workload import inputs as I
from workload.panel import r
from workload.registry import part, query, sql

_DESCRIBE = """
  SELECT symbol, COUNT({x}) AS count, ROUND(AVG({x}) + 1e-9, {d}) AS mean, ROUND(STDDEV_SAMP({x}), {d}) AS std,
    ROUND(MIN({x}), {d}) AS min, ROUND(quantile_cont({x}, 0.25) + 1e-9, {d}) AS q25, ROUND(quantile_cont({x}, 0.5) + 1e-9, {d}) AS q50,
    ROUND(quantile_cont({x}, 0.75) + 1e-9, {d}) AS q75, ROUND(MAX({x}), {d}) AS max,
    ROUND(SKEWNESS({x}), 6) AS skew, ROUND(KURTOSIS({x}), 6) AS kurtosis
  FROM rets GROUP BY 1"""


def _described(df, value, d):
    out = stats.describe(df, value)
    up = {c: F.round(F.col(c) + 1e-9, d) for c in ("mean", "q25", "q50", "q75")}
    return out.select("symbol", "count", *[up[c].alias(c) for c in up],
                      r("std", d), r("min", d), r("max", d), r("skew"), r("kurtosis"))


@query("describe_prices", sql(_DESCRIBE.format(x="close", d=4), "rets"))
def _(spark, folder):
    return _described(I.panel(spark, folder), "close", 4)


@query("describe_returns", sql(_DESCRIBE.format(x="ret", d=8), "rets"))
def _(spark, folder):
    return _described(I.returns(spark, folder), "ret", 8)


@query("panel_shape", sql("""SELECT COUNT(*) AS rows, COUNT(DISTINCT date) AS dates,
  COUNT(DISTINCT symbol) AS series FROM panel""", "panel"))
def _(spark, folder):
    return stats.panel_shape(I.panel(spark, folder))


@query("missing_report", sql("""
  SELECT symbol, d AS rows, d - k AS missing, ROUND((d - k) * 100.0::DOUBLE / d, 6) AS missing_pct
  FROM (SELECT symbol, COUNT(close) AS k FROM prices WHERE isodow(date) < 6 GROUP BY 1),
       (SELECT COUNT(DISTINCT date) AS d FROM prices WHERE isodow(date) < 6)""", "prices"))
def _(spark, folder):
    return stats.missing_report(I.prices(spark, folder)).select(
        "symbol", "rows", "missing", r("missing_pct"))


@query("return_summary", sql("""
  SELECT symbol, ROUND(AVG(close), 2) AS mean_price, ROUND(ROUND(STDDEV_SAMP(ret), 3) * 100, 6) AS volatility_pct,
    ROUND(AVG(ret) * 100, 3) AS avg_return_pct FROM rets GROUP BY 1""", "rets"))
def _(spark, folder):
    return stats.return_summary(I.returns(spark, folder)).select(
        "symbol", "mean_price", r("volatility_pct"), "avg_return_pct")


part("z", """
  SELECT symbol, date, ret, (ret - AVG(ret) OVER p) / NULLIF(STDDEV_POP(ret) OVER p, 0) AS z,
    (ret - AVG(ret) OVER p) / NULLIF(STDDEV_SAMP(ret) OVER p, 0) AS zs,
    AVG(ret) OVER p AS mu, STDDEV_SAMP(ret) OVER p AS sd
  FROM rets WINDOW p AS (PARTITION BY symbol)""", "rets")


@query("zscore_outliers", sql("""SELECT symbol, date, ROUND(z, 6) AS z, ABS(z) > 3 AS outlier,
  ROUND(zs, 6) AS z_sample FROM z""", "z"))
def _(spark, folder):
    pop = roll.zscores(I.returns(spark, folder))
    sample = roll.zscores(pop.withColumnsRenamed({"z": "zp", "outlier": "op"}), sample=True)
    return sample.select("symbol", "date", F.round("zp", 6).alias("z"),
                         F.col("op").alias("outlier"), F.round("z", 6).alias("z_sample"))


@query("outlier_counts", sql("""SELECT symbol, SUM(CASE WHEN ABS(z) > 3 THEN 1 ELSE 0 END)::BIGINT AS outliers
  FROM z GROUP BY 1""", "z"))
def _(spark, folder):
    return stats.outlier_counts(roll.zscores(I.returns(spark, folder)))


@query("winsorized_returns", sql("""
  SELECT symbol, date, CASE WHEN ret IS NOT NULL THEN ROUND(LEAST(GREATEST(ret, mu - 3 * sd), mu + 3 * sd), 8) END AS around_mean,
    CASE WHEN ret IS NOT NULL THEN ROUND(LEAST(GREATEST(ret, -3 * sd), 3 * sd), 8) END AS around_zero FROM z""", "z"))
def _(spark, folder):
    first = roll.winsorized(I.returns(spark, folder)).withColumnRenamed("clipped", "around_mean")
    return roll.winsorized(first, center="zero").select(
        "symbol", "date", r("around_mean", 8), F.round("clipped", 8).alias("around_zero"))


@query("median_replaced", sql("""
  SELECT symbol, date, ROUND(CASE WHEN ABS(z) > 3 THEN CASE WHEN k = 5 THEN med END ELSE ret END, 8) AS cleaned
  FROM (SELECT symbol, date, ret, z, COUNT(ret) OVER w AS k, quantile_cont(ret, 0.5) OVER w AS med FROM z
        WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""", "z"))
def _(spark, folder):
    return roll.rolling_median_replaced(I.returns(spark, folder)).select(
        "symbol", "date", r("cleaned", 8))


_HIST = """
  SELECT '{name}' AS series, symbol, bin, COUNT(*) AS n FROM (
    SELECT symbol, CAST(LEAST(FLOOR(({x} - MIN({x}) OVER p) / ((MAX({x}) OVER p - MIN({x}) OVER p) / 50)), 49) AS INTEGER) AS bin
    FROM {src} WHERE {x} IS NOT NULL WINDOW p AS (PARTITION BY symbol)) GROUP BY 1, 2, 3"""


@query("return_histogram", sql(
    _HIST.format(name="original", x="ret", src="z") + " UNION ALL " + _HIST.format(
        name="cleaned", x="c", src="(SELECT symbol, LEAST(GREATEST(ret, mu - 3 * sd), mu + 3 * sd) AS c FROM z WHERE ret IS NOT NULL)"),
    "z"))
def _(spark, folder):
    both = roll.winsorized(I.returns(spark, folder))
    a = stats.histogram(both, "ret").withColumn("series", F.lit("original"))
    b = stats.histogram(both, "clipped").withColumn("series", F.lit("cleaned"))
    return a.unionByName(b).select("series", "symbol", "bin", "n")


@query("return_correlation", sql("""
  , complete AS (SELECT * FROM rets WHERE date IN (SELECT date FROM rets WHERE ret IS NOT NULL
      GROUP BY 1 HAVING COUNT(*) = (SELECT COUNT(DISTINCT symbol) FROM rets)))
  SELECT a.symbol AS left_key, b.symbol AS right_key, ROUND(CORR(a.ret, b.ret), 8) AS corr
  FROM complete a JOIN complete b ON a.date = b.date GROUP BY 1, 2""", "rets"))
def _(spark, folder):
    return correlation.correlation_matrix(I.returns(spark, folder), "ret").select(
        "left_key", "right_key", r("corr", 8))


@query("price_correlation", sql("""
  , u AS (SELECT symbol, date, COALESCE(LAST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    FIRST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS close
  FROM (SELECT s.symbol, d.date, p.close AS c
        FROM (SELECT DISTINCT date FROM prices) d CROSS JOIN (SELECT DISTINCT symbol FROM prices) s
        LEFT JOIN prices p ON p.symbol = s.symbol AND p.date = d.date))
  SELECT a.symbol AS left_key, b.symbol AS right_key, ROUND(COALESCE(CORR(a.close, b.close), 0), 8) AS corr
  FROM u a JOIN u b ON a.date = b.date
  WHERE a.date >= (SELECT CAST(MAX(date) - INTERVAL 6 MONTH AS DATE) FROM prices) GROUP BY 1, 2""", "prices"))
def _(spark, folder):
    from tidepanel.operators.calendar import align_to_union

    joint = roll.calendar_range(align_to_union(I.prices(spark, folder)), "6mo")
    return correlation.correlation_matrix(joint, "close", zero_if_flat=True).select(
        "left_key", "right_key", r("corr", 8))


@query("supplier_correlation", sql("""
  , u AS (SELECT symbol, date, COALESCE(LAST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    FIRST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS close
  FROM (SELECT s.symbol, d.date, p.close AS c
        FROM (SELECT DISTINCT date FROM supplier_prices) d CROSS JOIN (SELECT DISTINCT symbol FROM supplier_prices) s
        LEFT JOIN supplier_prices p ON p.symbol = s.symbol AND p.date = d.date))
  SELECT a.symbol AS left_key, b.symbol AS right_key, ROUND(COALESCE(CORR(a.close, b.close), 0), 6) AS corr
  FROM u a JOIN u b ON a.date = b.date GROUP BY 1, 2""", "supplier_prices"))
def _(spark, folder):
    """Matrix of all suppliers on the union of their dates."""
    from tidepanel.operators.calendar import align_to_union

    joint = align_to_union(I.supplier_prices(spark, folder))
    return correlation.correlation_matrix(joint, "close", buckets=4, zero_if_flat=True).select(
        "left_key", "right_key", r("corr", 6))


@query("supplier_pair_correlation", sql("""
  , u AS (SELECT symbol, date, COALESCE(LAST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    FIRST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS close
  FROM (SELECT s.symbol, d.date, p.close AS c
        FROM (SELECT DISTINCT date FROM supplier_prices) d CROSS JOIN (SELECT DISTINCT symbol FROM supplier_prices) s
        LEFT JOIN supplier_prices p ON p.symbol = s.symbol AND p.date = d.date)),
  pairs AS (SELECT CAST(s_suppkey AS VARCHAR) AS l, CAST(LEAD(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS VARCHAR) AS r FROM supplier)
  SELECT l AS left_key, r AS right_key, ROUND(COALESCE(CORR(a.close, b.close), 0), 6) AS corr
  FROM pairs JOIN u a ON a.symbol = l JOIN u b ON b.symbol = r AND a.date = b.date GROUP BY 1, 2""", "supplier_prices"))
def _(spark, folder):
    """Each supplier with the next one of its nation, from a table of pairs."""
    from pyspark.sql import Window as W

    from tidepanel.operators.calendar import align_to_union

    peers = F.lead("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    pairs = I.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("left_key"), peers.alias("right_key"))
    joint = align_to_union(I.supplier_prices(spark, folder))
    return correlation.pair_correlation(joint, pairs, "close", size=32, zero_if_flat=True).select(
        "left_key", "right_key", r("corr", 6))


@query("decompose_additive", sql("""
  , t AS (SELECT symbol, date, close, rn, n, CASE WHEN rn > 126 AND rn <= n - 126 THEN
      (SUM(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 125 PRECEDING AND 125 FOLLOWING)
       + 0.5::DOUBLE * (LAG(close, 126) OVER (PARTITION BY symbol ORDER BY date)
              + LEAD(close, 126) OVER (PARTITION BY symbol ORDER BY date))) / 252 END AS trend FROM rets),
  ph AS (SELECT symbol, (rn - 1) % 252 AS k, AVG(close - trend) AS lv FROM t GROUP BY 1, 2),
  s AS (SELECT symbol, k, lv - AVG(lv) OVER (PARTITION BY symbol) AS seasonal FROM ph)
  SELECT t.symbol, date, ROUND(trend + 1e-6, 4) AS trend, ROUND(seasonal, 4) AS seasonal,
    ROUND(close - trend - seasonal, 4) AS resid
  FROM t JOIN s ON s.symbol = t.symbol AND s.k = (t.rn - 1) % 252""", "rets"))
def _(spark, folder):
    return decompose.decompose_additive(I.panel(spark, folder)).select(
        "symbol", "date", F.round(F.col("trend") + 1e-6, 4).alias("trend"), r("seasonal", 4), r("resid", 4))


@query("decompose_robust", sql("""
  , t AS (SELECT symbol, date, close, rn, quantile_cont(close, 0.5) OVER (PARTITION BY symbol ORDER BY date
      ROWS BETWEEN 126 PRECEDING AND 126 FOLLOWING) AS trend FROM rets),
  ph AS (SELECT symbol, (rn - 1) % 252 AS k, quantile_cont(close - trend, 0.5) AS lv FROM t GROUP BY 1, 2),
  s AS (SELECT symbol, k, lv - AVG(lv) OVER (PARTITION BY symbol) AS seasonal FROM ph)
  SELECT t.symbol, date, ROUND(trend, 4) AS trend, ROUND(seasonal, 4) AS seasonal,
    ROUND(close - trend - seasonal, 4) AS resid
  FROM t JOIN s ON s.symbol = t.symbol AND s.k = (t.rn - 1) % 252""", "rets"))
def _(spark, folder):
    return decompose.decompose_robust(I.panel(spark, folder)).select(
        "symbol", "date", r("trend", 4), r("seasonal", 4), r("resid", 4))


@query("acf", sql("""
  , c AS (SELECT symbol, rn, ret - AVG(ret) OVER (PARTITION BY symbol) AS x FROM rets WHERE ret IS NOT NULL),
  v AS (SELECT symbol, SUM(x * x) AS ss FROM c GROUP BY 1)
  SELECT a.symbol, CAST(k AS INTEGER) AS lag, ROUND(SUM(a.x * b.x) / MAX(ss), 8) AS acf
  FROM (SELECT UNNEST(range(0, 31)) AS k) CROSS JOIN c a JOIN c b ON a.symbol = b.symbol AND b.rn = a.rn - k
  JOIN v ON v.symbol = a.symbol GROUP BY 1, 2""", "rets"))
def _(spark, folder):
    return unitroot.acf(I.returns(spark, folder), "ret").select("symbol", "lag", r("acf", 8))


@query("pacf", sql("""
  , c AS (SELECT symbol, rn, ret - AVG(ret) OVER (PARTITION BY symbol) AS x FROM rets WHERE ret IS NOT NULL),
  r AS (SELECT symbol, list(rho ORDER BY k) AS rho FROM (
    SELECT a.symbol, k, SUM(a.x * b.x) / MAX(ss) AS rho
    FROM (SELECT UNNEST(range(1, 31)) AS k) CROSS JOIN c a JOIN c b ON a.symbol = b.symbol AND b.rn = a.rn - k
    JOIN (SELECT symbol, SUM(x * x) AS ss FROM c GROUP BY 1) v ON v.symbol = a.symbol GROUP BY 1, 2) GROUP BY 1),
  f AS (
    SELECT symbol, rho, 1 AS k, [rho[1]] AS phi, rho[1] AS p FROM r
    UNION ALL
    SELECT symbol, rho, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - a * phi[k + 1 - i]), a), a
    FROM (SELECT *, (rho[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[k + 1 - i])))
        / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[i]))) AS a FROM f WHERE k < 30))
  SELECT symbol, CAST(k AS INTEGER) AS lag, ROUND(p, 8) AS pacf FROM f
  UNION ALL SELECT symbol, 0, 1.0 FROM r""", "rets", recursive=True))
def _(spark, folder):
    return unitroot.pacf(I.returns(spark, folder), "ret").select("symbol", "lag", r("pacf", 8))


_ADF_SQL = """
  SELECT symbol, '{name}' AS series, COUNT(*) AS n,
    ROUND(REGR_SLOPE(y, x) / SQRT((REGR_SYY(y, x) - REGR_SLOPE(y, x) * REGR_SXY(y, x)) / ((COUNT(*) - 2) * REGR_SXX(y, x))), 5) AS statistic
  FROM (SELECT symbol, LAG(v) OVER (PARTITION BY symbol ORDER BY date) AS x,
          v - LAG(v) OVER (PARTITION BY symbol ORDER BY date) AS y FROM (SELECT symbol, date, {col} AS v FROM rets WHERE {col} IS NOT NULL))
  WHERE x IS NOT NULL GROUP BY 1"""
_ADF_SERIES = {"price": "close", "difference": "diff", "return": "ret", "log_return": "log_ret"}


@query("adf_lag0", sql(" UNION ALL ".join(
    _ADF_SQL.format(name=n, col=c) for n, c in _ADF_SERIES.items()), "rets"))
def _(spark, folder):
    base = I.returns(spark, folder)
    parts = [unitroot.adf_lag0(base, c).select("symbol", F.lit(n).alias("series"), "n",
                                               r("statistic", 5))
             for n, c in _ADF_SERIES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("adf_auto")
def _(spark, folder):
    """All four series of each symbol in one pass, keyed by symbol and series."""
    rows = F.array(*[F.struct(F.lit(n).alias("series"), F.col(c).alias("v"))
                     for n, c in _ADF_SERIES.items()])
    long = I.returns(spark, folder).select("symbol", "date", F.inline(rows)).select(
        F.concat_ws("|", "symbol", "series").alias("series_key"), "date", "v")
    out = unitroot.adf(long, "v", "series_key")
    return out.select(
        F.split("series_key", r"\|")[0].alias("symbol"),
        F.split("series_key", r"\|")[1].alias("series"),
        "used_lag", "n", r("statistic", 3), r("p_value", 4), "stationary")


@query("standardize", sql("""
  SELECT symbol, date, ROUND((ret - AVG(ret) OVER p) / CASE WHEN STDDEV_POP(ret) OVER p = 0 THEN 1 ELSE STDDEV_POP(ret) OVER p END, 6) AS ret_z,
    ROUND((close - AVG(close) OVER p) / CASE WHEN STDDEV_POP(close) OVER p = 0 THEN 1 ELSE STDDEV_POP(close) OVER p END, 6) AS close_z
  FROM rets WINDOW p AS (PARTITION BY symbol)""", "rets"))
def _(spark, folder):
    return stats.standardized(I.returns(spark, folder), ["ret", "close"]).select(
        "symbol", "date", r("ret_z"), r("close_z"))


@query("exog_normalize", sql("""
  SELECT code, date, ROUND((value - AVG(value) OVER p) / (STDDEV_SAMP(value) OVER p + 1e-6), 6) AS normalized
  FROM exog_long WINDOW p AS (PARTITION BY code)""", "exog_long"))
def _(spark, folder):
    from tidepanel.operators.calendar import align_to_common

    return stats.normalized_exog(align_to_common(I.exog(spark, folder), "code", "value")).select(
        "code", "date", r("normalized"))


@query("lookback_samples", sql("""
  SELECT symbol, date, ROUND(ret, 8) AS target, CAST(10 AS INTEGER) AS depth, ROUND(o, 8) AS oldest, ROUND(y, 8) AS newest,
    ROUND(s, 6) AS total
  FROM (SELECT symbol, date, rn, ret, LAG(ret, 10) OVER w AS o, LAG(ret, 1) OVER w AS y,
      SUM(ret) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS s
    FROM (SELECT * FROM rets WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY symbol ORDER BY date))
  WHERE rn > 11""", "rets"))
def _(spark, folder):
    rows = I.returns(spark, folder).where(F.col("ret").isNotNull())
    out = samples.lookback_samples(rows, ["ret", "close"], "ret", 10)
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x["ret"])
    return out.select(
        "symbol", "date", r("target", 8), F.size("window").alias("depth"),
        F.round(F.col("window")[0]["ret"], 8).alias("oldest"),
        F.round(F.element_at("window", -1)["ret"], 8).alias("newest"),
        F.round(total, 6).alias("total"))


@query("block_targets", sql("""
  , x AS (SELECT symbol, date, LN(1 + ret) AS lr, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY symbol) AS m
    FROM rets WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date))
  SELECT symbol, date, ROUND(y0, 8) AS y0, ROUND(y3, 8) AS y3 FROM (
    SELECT symbol, date, i, m, SUM(lr) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS y0,
      SUM(lr) OVER (w ROWS BETWEEN 15 FOLLOWING AND 19 FOLLOWING) AS y3
    FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date))
  WHERE i > 30 AND i <= m - 20""", "rets"))
def _(spark, folder):
    rows = I.returns(spark, folder).where(F.col("ret").isNotNull()).withColumn(
        "lr", F.log1p("ret"))
    return samples.block_targets(rows, "lr", 4, 5, 30).select(
        "symbol", "date", F.round(F.col("targets")[0], 8).alias("y0"),
        F.round(F.col("targets")[3], 8).alias("y3"))


@query("chrono_split", sql("""
  SELECT symbol, rn <= FLOOR(n * 0.8::DOUBLE) AS is_train, rn > n - 126 AS is_test, COUNT(*) AS k,
    MIN(date) AS lo, MAX(date) AS hi FROM rets GROUP BY 1, 2, 3""", "rets"))
def _(spark, folder):
    split = roll.chronological_split(I.panel(spark, folder)).drop("rn", "n")
    return roll.holdout(split, 126).groupBy("symbol", "is_train", "is_test").agg(
        F.count("*").alias("k"), F.min("date").alias("lo"), F.max("date").alias("hi"))


@query("mean_drift", sql("""
  SELECT symbol, ROUND(AVG(ret), 9) AS drift_all, ROUND(AVG(ret) FILTER (n - rn < 60), 9) AS drift_last
  FROM rets WHERE ret IS NOT NULL GROUP BY 1""", "rets"))
def _(spark, folder):
    return stats.mean_drift(I.returns(spark, folder)).select(
        "symbol", r("drift_all", 9), r("drift_last", 9))
