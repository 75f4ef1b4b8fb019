"""Seasonal decomposition of every series in window passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.operators.calendar import series
from tidepanel.operators.rolling import numbered


def _finish(df: DataFrame, phase_level, value: str, key: str) -> DataFrame:
    """Centre the phase levels of each series on zero and subtract.

    Levels and their mean over the phases are window aggregates below the same
    partitioning by key, so nothing is joined back and no row moves again.
    """
    phase = W.partitionBy(key, "_phase")
    rows = df.withColumns({
        "_level": phase_level.over(phase), "_k": F.count(F.lit(1)).over(phase)})
    share = F.when(F.col("_level").isNotNull(), 1 / F.col("_k"))
    whole = W.partitionBy(key)
    rows = rows.withColumns({
        "_sum": F.sum(F.col("_level") / F.col("_k")).over(whole),
        "_phases": F.round(F.sum(share).over(whole)),
    }).withColumn("seasonal", F.col("_level") - F.col("_sum") / F.col("_phases"))
    return rows.withColumn(
        "resid", F.col(value) - F.col("trend") - F.col("seasonal")
    ).select(key, "date", value, "trend", "seasonal", "resid")


def decompose_additive(df: DataFrame, period: int = 252, value: str = "close",
                       key: str = "symbol") -> DataFrame:
    """Trend = centred moving mean (half weights at both ends of an even period),
    seasonal = centred mean of the detrended values by phase, residual = rest.
    The trend is null for half a period at both ends."""
    half = period // 2
    w = series(key)
    inner = half - 1 if period % 2 == 0 else half
    inside = F.sum(value).over(w.rowsBetween(-inner, inner))
    rows = numbered(df, key)
    if period % 2 == 0:
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        total = inside + 0.5 * ends
    else:
        total = inside
    full = (F.col("rn") > half) & (F.col("rn") <= F.col("n") - half)
    rows = rows.withColumn("trend", F.when(full, total / period)).withColumn(
        "_phase", (F.col("rn") - 1) % period
    )
    return _finish(rows, F.avg(F.col(value) - F.col("trend")), value, key)


def decompose_robust(df: DataFrame, period: int = 252, value: str = "close",
                     key: str = "symbol") -> DataFrame:
    """Same parts by medians, which one outlier does not move; the trend window
    is cut at the ends, so every row has a value."""
    half = period // 2
    frame = series(key).rowsBetween(-half, half)
    rows = numbered(df, key).withColumns({
        "trend": F.percentile(value, 0.5).over(frame),
        "_phase": (F.col("rn") - 1) % period,
    })
    return _finish(rows, F.percentile(F.col(value) - F.col("trend"), 0.5), value, key)
