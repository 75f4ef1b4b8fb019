"""Training samples for the learned forecaster: lookback windows and block targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators.calendar import series
from tidepanel.operators.rolling import numbered


def lookback_samples(df: DataFrame, features: list[str], target: str, lookback: int,
                     key: str = "symbol") -> DataFrame:
    """Per row: the features of the ``lookback`` rows before it (oldest first) and its
    own target. Rows with a shorter past are left out."""
    frame = series(key).rowsBetween(-lookback, -1)
    window = F.collect_list(F.struct(*features)).over(frame)
    return (
        df.withColumn("window", window)
        .where(F.size("window") == lookback)
        .select(key, "date", "window", F.col(target).alias("target"))
    )


def flat_window(df: DataFrame, features: list[str], lookback: int,
                key: str = "symbol", *, past_only: bool = True) -> DataFrame:
    """``x``: the lookback rows as one array of doubles, oldest row first."""
    frame = series(key).rowsBetween(-lookback, -1) if past_only else series(key).rowsBetween(
        -(lookback - 1), 0)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(frame)
    return df.withColumn("x", F.flatten(rows))


def block_targets(df: DataFrame, log_ret: str, blocks: int, agg_step: int, lookback: int,
                  key: str = "symbol") -> DataFrame:
    """``targets[k]``: sum of ``agg_step`` log returns from ``k * agg_step`` rows ahead.

    One forward sum per row, then shifted: the cost does not grow with ``blocks``.
    Kept are the rows with a full past and all targets strictly before the last row.
    """
    w = series(key)
    ahead = F.sum(log_ret).over(w.rowsBetween(0, agg_step - 1))
    rows = numbered(df, key).withColumn("_s", ahead)
    targets = F.array(*[F.lead("_s", k * agg_step).over(w) for k in range(blocks)])
    inside = (F.col("rn") > lookback) & (F.col("rn") <= F.col("n") - blocks * agg_step)
    return rows.withColumn("targets", targets).where(inside).drop("_s", "rn", "n")
