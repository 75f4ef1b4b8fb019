"""Constant-drift paths: the fallback of the learned model and a floor for the board."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel import settings as S
from tidepanel.functions.dates import business_horizon, next_business_days
from tidepanel.functions.scalars import clip
from tidepanel.operators.rolling import numbered, pct_change


def drift_fits(panel: DataFrame, steps: list[int], model: str = "drift") -> DataFrame:
    """Same columns as the regression fits: one row per (symbol, steps, kind).

    The price grows by the clipped mean return of the training rows; a series
    without a return stays flat.
    """
    rows = numbered(panel.withColumn("_r", pct_change("close")))
    tries = F.array(*[
        F.struct(F.lit(int(s)).alias("steps"), F.lit(kind).alias("kind"),
                 F.lit(S.business_horizon(s) if kind == "backtest" else 0).alias("held"))
        for s in steps for kind in ("backtest", "future")])
    each = rows.select("symbol", "date", "close", "_r", "rn", "n", F.inline(tries))
    train = F.col("rn") <= F.col("n") - F.col("held")
    sums = each.groupBy("symbol", "steps", "kind").agg(
        F.avg(F.when(train, F.col("_r"))).alias("drift"),
        F.max_by(F.when(train, F.col("close")), F.when(train, F.col("rn"))).alias("last_price"),
        F.max(F.when(train, F.col("date"))).alias("last_date"),
        F.sum(train.cast("long")).alias("n_train"),
        F.array_sort(F.collect_list(F.when(
            ~train, F.struct("date", F.col("close").alias("actual"))))).alias("test"),
    ).withColumn("h", business_horizon("steps"))
    bound = F.when(F.col("h") > 63, S.learned_settings(365).clip).otherwise(
        S.learned_settings(7).clip)
    growth = 1 + F.coalesce(clip("drift", bound), F.lit(0.0))
    path = F.transform(F.sequence(F.lit(1), F.col("h")),
                       lambda k: F.col("last_price") * F.pow(growth, k))
    enough = F.col("n_train") >= 1
    return sums.select(
        "symbol", F.lit(model).alias("model"), "steps", "kind", "h", "n_train", "last_price",
        "last_date", "test", "drift",
        F.when(enough, "ok").otherwise("error").alias("status"),
        F.when(enough, F.lit(None)).otherwise("no rows").cast("string").alias("error"),
        F.when(enough, path).alias("path"),
    )


def exog_paths(exog: DataFrame, steps: int, seed: int = 7, *, sigma_scale: float = 1.0) -> DataFrame:
    """Geometric random walk per code from its return mean and deviation.

    Draws are fixed by (seed, code, step), so a rerun or a lost executor gives the
    same path. A series without returns stays at its last value.
    """
    from tidepanel.plans.arima import hashed_normal

    h = S.business_horizon(steps)
    moves = exog.withColumn("_r", pct_change("value", "code"))
    sums = moves.groupBy("code").agg(
        F.avg("_r").alias("mu"), F.stddev_samp("_r").alias("sigma"),
        F.max_by("value", "date").alias("last"), F.max("date").alias("last_date"))
    draw = hashed_normal(F.lit(seed), F.col("code"), F.col("step"))
    rows = sums.select("*", F.posexplode(next_business_days("last_date", h))).select(
        "code", "mu", "sigma", "last", (F.col("pos") + 1).alias("step"), F.col("col").alias("date"))
    shock = F.coalesce(F.col("mu"), F.lit(0.0)) + sigma_scale * F.coalesce(
        F.col("sigma"), F.lit(0.0)) * draw
    from pyspark.sql import Window as W

    w = W.partitionBy("code").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_g", 1 + shock).withColumn(
        "value", F.col("last") * F.product("_g").over(w)).select("code", "step", "date", "value")
