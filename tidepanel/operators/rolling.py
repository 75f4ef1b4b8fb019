"""Returns, differences, trailing statistics, slices and splits of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions.dates import col_of, period_start
from tidepanel.operators.calendar import series, so_far


def pct_change(value, key: str = "symbol") -> Column:
    """x / previous x - 1; null after a 0 or a gap instead of an infinity."""
    value = col_of(value)
    return F.try_divide(value, F.lag(value).over(series(key))) - 1


def difference(value, lag: int = 1, key: str = "symbol") -> Column:
    value = col_of(value)
    return value - F.lag(value, lag).over(series(key))


def log_difference(value, key: str = "symbol") -> Column:
    value = col_of(value)
    logged = F.when(value > 0, F.ln(value))
    return logged - F.lag(logged).over(series(key))


def trailing(agg, value, rows: int, key: str = "symbol", min_rows: int | None = None) -> Column:
    """``agg`` over the last ``rows`` rows; null until ``min_rows`` values are there.

    Use the result as a column of its own: a window expression that appears twice
    in a projection is evaluated twice.
    """
    value = col_of(value)
    frame = series(key).rowsBetween(-(rows - 1), 0)
    need = rows if min_rows is None else min_rows
    if need <= 1:
        return agg(value).over(frame)
    return F.when(F.count(value).over(frame) >= need, agg(value).over(frame))


def with_returns(df: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    return df.withColumns({
        "ret": pct_change(value, key),
        "diff": difference(value, 1, key),
        "log_ret": log_difference(value, key),
    })


def trailing_means(df: DataFrame, value: str, means: dict[str, int], key: str = "symbol") -> DataFrame:
    """Means of the last ``rows`` rows, by column name; null until that many values are there.

    Constant work per row for any length: a running sum and count, each minus its own value ``rows`` rows before.
    The sums are decimals of 12 places, so the difference is exact however long the series is.
    """
    w = series(key)
    total = F.sum(F.col(value).cast("decimal(38,12)")).over(so_far(key))
    out = df.withColumns({"_total": F.coalesce(total, F.lit(0).cast("decimal(38,12)")),
                          "_count": F.count(value).over(so_far(key))})
    parts = {}
    for rows in set(means.values()):
        parts[f"_total{rows}"] = F.col("_total") - F.coalesce(F.lag("_total", rows).over(w), F.lit(0).cast("decimal(38,12)"))
        parts[f"_count{rows}"] = F.col("_count") - F.coalesce(F.lag("_count", rows).over(w), F.lit(0))
    out = out.withColumns(parts).withColumns({
        name: F.when(F.col(f"_count{rows}") >= rows, F.col(f"_total{rows}").cast("double") / rows)
        for name, rows in means.items()})
    return out.drop("_total", "_count", *parts)


def moving_averages(df: DataFrame, value: str = "close") -> DataFrame:
    return trailing_means(df, value, {"ma50": 50, "ma200": 200})


def rolling_volatility(df: DataFrame, value: str = "close", rows: int = 20) -> DataFrame:
    """Sample deviation of returns: with any history, full window in percent, scaled."""
    frame = series().rowsBetween(-(rows - 1), 0)
    rets = df.withColumn("ret", pct_change(value)).withColumns({
        "_std": F.stddev_samp("ret").over(frame), "_k": F.count("ret").over(frame)})
    full = F.when(F.col("_k") >= rows, F.col("_std"))
    return rets.withColumns({
        "vol_any": F.coalesce("_std", F.lit(0.0)),
        "vol_pct": full * 100,
        "vol_scaled_pct": full * float(rows) ** 0.5 * 100,
    }).drop("_std", "_k")


def level_volatility(df: DataFrame, value: str = "close", rows: int = 20) -> DataFrame:
    """Population deviation of the price level."""
    return df.withColumn("level_vol", trailing(F.stddev_pop, value, rows))


def numbered(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Row position from the start (``rn``) and the row count (``n``) of each series.

    Both come from one sorted pass: the distance to the end is ``n - rn``.
    """
    return df.withColumns({
        "rn": F.row_number().over(series(key)),
        "n": F.count(F.lit(1)).over(W.partitionBy(key)),
    })


def last_rows(df: DataFrame, rows: int, key: str = "symbol") -> DataFrame:
    """At most the newest ``rows`` rows of each series, in any order."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("date").desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= rows).drop("_rank")


def holdout(df: DataFrame, test_rows, key: str = "symbol") -> DataFrame:
    """``is_test`` marks the last ``test_rows`` rows."""
    test_rows = F.lit(test_rows) if isinstance(test_rows, int) else col_of(test_rows)
    return numbered(df, key).withColumn("is_test", F.col("rn") > F.col("n") - test_rows)


def chronological_split(df: DataFrame, share: float = 0.8, key: str = "symbol") -> DataFrame:
    return numbered(df, key).withColumn(
        "is_train", F.col("rn") <= F.floor(F.col("n") * F.lit(share))
    )


def downsample(df: DataFrame, every, key: str = "symbol") -> DataFrame:
    """Every ``every``-th row from the first, plus the last row."""
    every = F.lit(every) if isinstance(every, int) else col_of(every)
    kept = ((F.col("rn") - 1) % every == 0) | (F.col("rn") == F.col("n"))
    return numbered(df, key).where(kept)


def downsample_step(steps) -> Column:
    """Charts of 180 days keep each 7th point, of 365 days each 30th, others all."""
    steps = col_of(steps)
    return F.when(steps == 180, 7).when(steps == 365, 30).otherwise(1)


def last_day(key: str = "symbol") -> Column:
    return F.max("date").over(W.partitionBy(key))


def calendar_range(df: DataFrame, name: str, key: str = "symbol") -> DataFrame:
    """``1mo`` / ``6mo`` / ``ytd`` back from the last date of the series; else all."""
    end = last_day(key)
    start = {
        "1mo": F.add_months("_end", -1),
        "6mo": F.add_months("_end", -6),
        "ytd": F.trunc("_end", "year"),
    }.get(name)
    if start is None:
        return df
    return df.withColumn("_end", end).where(F.col("date") >= start).drop("_end")


def period_slice(df: DataFrame, period: str, key: str = "symbol") -> DataFrame:
    """Rows after ``last date - period``, such as ``6mo``, ``2y``, ``7d``."""
    return (
        df.withColumn("_end", last_day(key))
        .where(F.col("date") > period_start("_end", F.lit(period)))
        .drop("_end")
    )


def year_to_date(df: DataFrame, as_of) -> DataFrame:
    return df.where(F.col("date") >= F.trunc(col_of(as_of), "year"))


TRADING_DAYS = {"1wk": 5, "1mo": 21, "6mo": 126, "1y": 252}  # fixed values


def trading_range(df: DataFrame, name: str, key: str = "symbol") -> DataFrame:
    rows = TRADING_DAYS.get(name)
    return df if rows is None else last_rows(df, rows, key)


def rebased(df: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    """100 at the first row of each series."""
    first = F.first(value).over(so_far(key))
    return df.withColumn("rebased", F.try_divide(F.col(value), first) * 100)


def relative_performance(df: DataFrame, benchmark: DataFrame, *, by: str = "date",
                         key: str = "symbol", value: str = "close") -> DataFrame:
    """Rebased value minus the rebased benchmark.

    ``by='date'`` joins on the date; ``by='position'`` joins the i-th rows.
    """
    one = benchmark.select(F.lit(0).alias("_b"), "date", F.col(value).alias("close"))
    base = rebased(one, "close", "_b").select("_b", "date", F.col("rebased").alias("bench"))
    left = rebased(df, value, key)
    if by == "date":
        joined = left.join(base.select("date", "bench"), "date")
    else:
        base = base.withColumn("rn", F.row_number().over(series("_b"))).select("rn", "bench")
        joined = left.withColumn("rn", F.row_number().over(series(key))).join(base, "rn").drop("rn")
    return joined.select(
        key, "date", (F.col("rebased") - F.col("bench")).alias("relative_pct")
    )


def compounded(df: DataFrame, ret: str, last_price, keys: list[str], order: str = "step") -> DataFrame:
    """Price path ``last_price * prod(1 + r)`` as an exponential of running log sums."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("price", col_of(last_price) * F.exp(F.sum(F.log1p(F.col(ret))).over(w)))


def zscores(df: DataFrame, value: str = "ret", *, sample: bool = False,
            key: str = "symbol") -> DataFrame:
    w = W.partitionBy(key)
    std = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), std)
    return df.withColumn("z", z).withColumn("outlier", F.abs("z") > 3)


def winsorized(df: DataFrame, value: str = "ret", *, center: str = "mean", width: float = 3.0,
               key: str = "symbol") -> DataFrame:
    """Clip to ``width`` sample deviations around the mean or around zero."""
    w = W.partitionBy(key)
    rows = df.withColumns({
        "_mid": F.avg(value).over(w) if center == "mean" else F.lit(0.0),
        "_band": F.stddev_samp(value).over(w) * width,
    })
    low, high = F.col("_mid") - F.col("_band"), F.col("_mid") + F.col("_band")
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), low), high))
    return rows.withColumn("clipped", clipped).drop("_mid", "_band")


def rolling_median_replaced(df: DataFrame, value: str = "ret", key: str = "symbol") -> DataFrame:
    """Outliers replaced by the centred median of five rows."""
    frame = series(key).rowsBetween(-2, 2)
    median = F.when(F.count(value).over(frame) == 5, F.percentile(value, 0.5).over(frame))
    marked = zscores(df, value, key=key)
    return marked.withColumn("cleaned", F.when(F.col("outlier"), median).otherwise(F.col(value)))


def first_and_last(df: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    """First value, last value and change in percent per series; map-side combined."""
    return df.groupBy(key).agg(
        F.min_by(value, "date").alias("first_close"),
        F.max_by(value, "date").alias("last_close"),
    ).withColumn(
        "change_pct",
        F.try_divide(F.col("last_close") - F.col("first_close"), F.col("first_close")) * 100,
    )


def seasonal_difference(df: DataFrame, m: int, value: str = "close", key: str = "symbol") -> DataFrame:
    return df.withColumn("seasonal_diff", difference(value, m, key))


