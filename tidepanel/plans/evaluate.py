"""Backtest metrics, leaderboards and model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel import settings as S

EPS = 1e-8  # fixed value: guard in the denominators
STILL = 1e-12  # a smaller relative move is rounding noise of a flat path
RUN = ["symbol", "model", "steps"]


def with_actual(points: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecast days joined with the price of that day."""
    return points.join(panel.select("symbol", "date", F.col("close").alias("actual")),
                       ["symbol", "date"])


def backtest_metrics(points: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Seven error measures per key from (step, price, actual, last_price).

    A run has at most ``horizon`` rows, so the window over a run is small.
    """
    w = W.partitionBy(*keys).orderBy("step")

    def step_return(name: str) -> Column:
        before = F.lag(name).over(w)
        return (F.col(name) - before) / (before + EPS)

    rows = points.withColumns({"_ra": step_return("actual"), "_rp": step_return("price")})
    y, p, b = F.col("actual"), F.col("price"), F.col("last_price")

    def direction(name: str) -> Column:
        return F.when(F.abs(name) < STILL, 0.0).otherwise(F.signum(name))

    both = F.col("_ra").isNotNull() & F.col("_rp").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (200 * F.avg(F.abs(p - y) / (F.abs(p) + F.abs(y) + EPS))).alias("smape_pct"),
        (100 * F.avg(F.abs((p - y) / (y + EPS)))).alias("mape_pct"),
        F.avg(F.abs(F.col("_ra") - F.col("_rp"))).alias("mae_ret"),
        (100 * F.avg(F.when(both, (direction("_ra") == direction("_rp")).cast("double"))))
        .alias("dir_acc_pct"),
        (100 * F.avg(F.abs(y / (b + EPS) - p / (b + EPS)))).alias("mae_norm_pct"),
    )


def mae_pct(mae, last_price) -> Column:
    """Error in percent of the last price; 0 when either is missing or 0."""
    share = F.try_divide(F.col(mae), F.col(last_price)) * 100
    return F.coalesce(share, F.lit(0.0))


def model_rank(model="model") -> Column:
    out: Column = F.lit(len(S.MODELS))
    for i, m in enumerate(S.MODELS):
        out = F.when(F.lower(model) == m, i).otherwise(out)
    return out


def best_models(runs: DataFrame, keys=("symbol", "steps"), error: str = "backtest_mae") -> DataFrame:
    """Model with the smallest error per key; the earlier model of the fixed order wins ties."""
    known = runs.where(F.col(error).isNotNull())
    body = F.struct("model", error)
    return known.groupBy(*keys).agg(
        F.min_by(body, F.struct(F.col(error), model_rank())).alias("_b")
    ).select(*keys, F.upper("_b.model").alias("best_model"), F.col(f"_b.{error}").alias("best_mae"))


def leaderboard(metrics: DataFrame, error: str = "mae") -> DataFrame:
    """Models of each (symbol, steps) ranked by error."""
    w = W.partitionBy("symbol", "steps").orderBy(F.col(error), model_rank())
    return metrics.withColumn("place", F.row_number().over(w))


def comparison(runs: DataFrame, points: DataFrame) -> DataFrame:
    """Per (symbol, steps, model): error, error in percent, last forecast and the best model."""
    last = points.where(F.col("kind") == "future").groupBy(*RUN).agg(
        F.round(F.max_by("price", "step"), 2).alias("forecast_last"))
    rows = runs.join(last, RUN, "left").withColumn(
        "backtest_mae_pct", mae_pct("backtest_mae", "last_price"))
    w = W.partitionBy("symbol", "steps")
    best = F.min_by(F.col("model"), F.struct("backtest_mae", model_rank())).over(w)
    return rows.withColumn("best_model", F.upper(best))


def metric_pivot(metrics: DataFrame, value: str, steps: list[int]) -> DataFrame:
    """Error by symbol and model, one column per horizon."""
    wide = metrics.groupBy("symbol", "model").pivot("steps", steps).agg(F.first(value))
    return wide.toDF("symbol", "model", *[f"{value}_{s}" for s in steps])


def horizon_table(metrics: DataFrame, models: list[str], value: str) -> DataFrame:
    """Error by symbol and horizon, one column per model."""
    wide = metrics.groupBy("symbol", "steps").pivot("model", models).agg(F.first(value))
    return wide.toDF("symbol", "steps", *[f"{m}_{value}" for m in models])


def experiment_rows(metrics: DataFrame, batch_id: str, **settings) -> DataFrame:
    """Metric rows under the fixed column names of the experiment log."""
    named = {"mae": "MAE$", "rmse": "RMSE$", "smape_pct": "sMAPE%", "mape_pct": "MAPE%",
             "mae_ret": "MAE_ret", "dir_acc_pct": "DirAcc%", "mae_norm_pct": "MAE_norm%",
             "symbol": "ticker"}
    out = metrics.withColumnsRenamed(named).withColumn("batch_id", F.lit(batch_id))
    run = F.concat_ws("_", "ticker", F.col("steps").cast("string"), "model", "batch_id")
    return out.withColumn("run_id", run).withColumns({k: F.lit(v) for k, v in settings.items()})
