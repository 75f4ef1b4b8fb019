"""Descriptive statistics, missing values, histograms and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.functions.dates import is_weekday


def describe(df: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    """Count, mean, std, min, quartiles (linear), max, corrected skew and kurtosis."""
    x = F.col(value)
    base = df.groupBy(key).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.max(x).alias("max"),
        F.skewness(x).alias("_g1"),
        F.kurtosis(x).alias("_g2"),
    )
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(
        n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    )
    return base.select(
        key, "count", "mean", "std", "min",
        F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"),
        "max", skew.alias("skew"), kurt.alias("kurtosis"),
    )


def missing_report(prices: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Weekdays without a value on the union of the dates of all series, as a wide
    table shows them. Counted as (dates of the union) - (values of the series)."""
    days = prices.where(is_weekday("date")).agg(F.countDistinct("date").alias("d")).scalar()
    have = (
        prices.where(is_weekday("date")).groupBy(key)
        .agg(F.count(value).alias("have"))
        .withColumn("rows", days)
    )
    return have.select(
        key, "rows", (F.col("rows") - F.col("have")).alias("missing"),
        ((F.col("rows") - F.col("have")) / F.col("rows") * 100).alias("missing_pct"),
    )


def panel_shape(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("date").alias("dates"),
        F.countDistinct(key).alias("series"),
    )


def return_summary(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Mean price (2 dp), deviation of returns in percent, mean return in percent (3 dp)."""
    return df.groupBy(key).agg(
        F.round(F.avg("close"), 2).alias("mean_price"),
        (F.round(F.stddev_samp("ret"), 3) * 100).alias("volatility_pct"),
        F.round(F.avg("ret") * 100, 3).alias("avg_return_pct"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50, key: str = "symbol") -> DataFrame:
    """Equal bins between minimum and maximum of each series; the maximum is in the last bin.

    The range is one small row per series, so the counting itself stays map-side.
    """
    known = df.where(F.col(value).isNotNull())
    span = known.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0))
    return (
        known.join(span, key)
        .select(key, F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy(key, "bin").agg(F.count("*").alias("n"))
    )


def standardized(df: DataFrame, cols: list[str], key: str = "symbol", *, train=None) -> DataFrame:
    """(x - mean) / population std per series; a flat series divides by 1.

    With ``train`` (a boolean column name) the scale comes from those rows only.
    """
    def seen(c):
        return F.col(c) if train is None else F.when(F.col(train), F.col(c))

    w = W.partitionBy(key)
    out = {}
    for c in cols:
        std = F.stddev_pop(seen(c)).over(w)
        out[f"{c}_mean"] = F.avg(seen(c)).over(w)
        out[f"{c}_std"] = F.when(std == 0, 1.0).otherwise(std)
    scaled = df.withColumns(out)
    return scaled.withColumns({
        f"{c}_z": (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in cols
    })


def normalized_exog(df: DataFrame, value: str = "value", key: str = "code") -> DataFrame:
    """(x - mean) / (sample std + 1e-6) per exogenous series."""
    w = W.partitionBy(key)
    return df.withColumn(
        "normalized",
        (F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-6),
    )


def mean_drift(df: DataFrame, ret: str = "ret", last: int = 60, key: str = "symbol") -> DataFrame:
    """Mean return over all history and over the last ``last`` returns."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("date").desc()))
    known = df.where(F.col(ret).isNotNull()).withColumn("_rank", rank)
    return known.groupBy(key).agg(
        F.avg(ret).alias("drift_all"),
        F.avg(F.when(F.col("_rank") <= last, F.col(ret))).alias("drift_last"),
    )


def outlier_counts(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col("outlier").cast("int")).alias("outliers"))
