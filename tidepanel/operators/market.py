"""Prices joined with exogenous series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.scalars import finite, safe_name, safe_name_col
from tidepanel.operators.calendar import align_to_common, fill_gaps, series, so_far
from tidepanel.sources.readers import EmptySource


def exog_wide(exog: DataFrame, codes: list[str]) -> DataFrame:
    """One column per code on a common weekday grid, filled both ways.

    The aligned long form is pivoted once, which equals a chain of full outer
    merges on the date. The result has one row per weekday, whatever the input. Codes
    are compared by their safe name, so ``CL=F`` finds rows stored as ``cl_f``.
    """
    names = [safe_name(c) for c in codes]
    named = exog.withColumn("code", safe_name_col("code")).where(F.col("code").isin(names))
    wide = (
        align_to_common(named, "code", "value")
        .groupBy("date").pivot("code", names).agg(F.first("value", ignorenulls=True))
    )
    return wide.fillna(0.0)


def require_codes(exog: DataFrame, codes: list[str]) -> DataFrame:
    """``exog`` as it is; an error names the codes that have no row. At most the requested names reach the driver."""
    names = [safe_name(c) for c in codes]
    found = exog.select(safe_name_col("code").alias("c")).where(F.col("c").isin(names)).distinct()
    missing = sorted(set(names) - {r[0] for r in found.collect()})
    if missing:
        raise EmptySource(f"no rows for {', '.join(missing)}")
    return exog


def market_table(prices: DataFrame, exog: DataFrame | None) -> DataFrame:
    """prices left join exog on date; a date without exog holds 0.

    No join hint: the exog side has one row per weekday, and the engine broadcasts
    it when its measured size allows.
    """
    base = prices.select("date", "symbol", finite("close").alias("close")).dropna(subset=["close"])
    if exog is None:
        return base
    cols = [c for c in exog.columns if c != "date"]
    return base.join(exog, "date", "left").select(
        "date", "symbol", "close",
        *[F.coalesce(finite(c), F.lit(0.0)).alias(c) for c in cols],
    )


def exog_on_series(prices: DataFrame, exog: DataFrame, key: str = "symbol") -> DataFrame:
    """Exog on the dates of each series: forward fill, back fill, then 0."""
    cols = [c for c in exog.columns if c != "date"]
    return fill_gaps(prices.join(exog, "date", "left"), cols, key)


def exog_returns(df: DataFrame, cols: list[str], key: str = "symbol") -> DataFrame:
    """Relative changes of the exog columns, carried over gaps; rows without any are dropped."""
    w = series(key)

    def change(c: str) -> Column:
        return F.try_divide(F.col(c), F.lag(c).over(w)) - 1

    moved = df.withColumns({f"ex_{c}": change(c) for c in cols})
    running = so_far(key)
    filled = moved.withColumns({
        f"ex_{c}": F.last(f"ex_{c}", ignorenulls=True).over(running) for c in cols
    })
    return filled.dropna(how="all", subset=[f"ex_{c}" for c in cols])


def on_series_dates(exog: DataFrame, prices: DataFrame) -> DataFrame:
    """Exog rows on dates that some series has."""
    return exog.join(prices.select("date").distinct(), "date", "left_semi")
