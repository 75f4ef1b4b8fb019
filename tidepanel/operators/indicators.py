"""Technical indicators on an aligned panel.

``strict=False`` gives a value in every row (any history is enough), as the nightly
job uses it; ``strict=True`` gives null until the window is full, as the
on-demand path uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.calendar import fill_gaps, series
from tidepanel.operators.ewm import alpha_of_span, alpha_of_wilder, with_ewm
from tidepanel.operators.rolling import pct_change, trailing


def _warm(value: Column, rows: int, strict: bool, key: str) -> Column:
    if not strict:
        return value
    return F.when(F.row_number().over(series(key)) >= rows, value)


def ema(df: DataFrame, spans=(10, 50), value: str = "close", *, strict: bool = False,
        key: str = "symbol") -> DataFrame:
    out = with_ewm(df, {f"ema{n}": (value, alpha_of_span(n)) for n in spans}, key)
    return out.withColumns({f"ema{n}": _warm(F.col(f"ema{n}"), n, strict, key) for n in spans})


def _moves(df: DataFrame, value: str, key: str) -> DataFrame:
    step = F.coalesce(F.col(value) - F.lag(value).over(series(key)), F.lit(0.0))
    return df.withColumns({"_gain": F.greatest(step, F.lit(0.0)),
                           "_loss": F.greatest(-step, F.lit(0.0))})


def _rsi(gain: str, loss: str) -> Column:
    ratio = F.try_divide(F.col(gain), F.col(loss))
    return F.when(F.col(loss) == 0, 100.0).otherwise(100 - 100 / (1 + ratio))


def rsi(df: DataFrame, n: int = 14, value: str = "close", *, strict: bool = False,
        key: str = "symbol") -> DataFrame:
    a = alpha_of_wilder(n)
    out = with_ewm(_moves(df, value, key), {"_up": ("_gain", a), "_down": ("_loss", a)}, key)
    out = out.withColumn(f"rsi{n}", _warm(_rsi("_up", "_down"), n, strict, key))
    return out.drop("_gain", "_loss", "_up", "_down")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, sign: int = 9, value: str = "close",
         *, strict: bool = False, key: str = "symbol") -> DataFrame:
    out = with_ewm(df, {"_fast": (value, alpha_of_span(fast)),
                        "_slow": (value, alpha_of_span(slow))}, key)
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow"))
    out = with_ewm(out, {"macd_signal": ("macd", alpha_of_span(sign))}, key)
    return out.withColumns({
        "macd": _warm(F.col("macd"), slow, strict, key),
        "macd_signal": _warm(F.col("macd_signal"), slow + sign - 1, strict, key),
    }).drop("_fast", "_slow")


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0, value: str = "close", *,
              strict: bool = False, key: str = "symbol") -> DataFrame:
    """Position inside the band; ``strict=False`` guards an empty band by 1e-9.

    A deviation below 1e-10 of the mean is rounding noise of a flat window, which
    has position 0 (strict: none).
    """
    need = n if strict else 1
    rows = df.withColumns({
        "_mid": trailing(F.avg, value, n, key, need),
        "_std": trailing(F.stddev_pop, value, n, key, need),
    })
    low, band = F.col("_mid") - width * F.col("_std"), 2 * width * F.col("_std")
    flat = F.col("_std") <= 1e-10 * F.abs("_mid")
    pct = (F.when(~flat, (F.col(value) - low) / band) if strict
           else F.when(flat, 0.0).otherwise((F.col(value) - low) / (band + 1e-9)))
    return rows.withColumns({"bb_low": low, "bb_high": low + band, "bb_pct": pct}).drop(
        "_mid", "_std")


def indicator_matrix(df: DataFrame, value: str = "close", key: str = "symbol") -> DataFrame:
    """All indicators of the nightly job, without nulls: forward, back, then 0.

    One partitioning by key serves every window; the six recursive means of the
    first level share one scan and the signal line takes a second.
    """
    wide = _moves(df.withColumn("_ret", pct_change(value, key)), value, key)
    wilder = alpha_of_wilder(14)
    wide = with_ewm(wide, {
        "ind_ema10": (value, alpha_of_span(10)),
        "ind_ema50": (value, alpha_of_span(50)),
        "_up": ("_gain", wilder),
        "_down": ("_loss", wilder),
        "_fast": (value, alpha_of_span(12)),
        "_slow": (value, alpha_of_span(26)),
    }, key)
    wide = wide.withColumns({
        "ind_rsi14": _rsi("_up", "_down"),
        "ind_macd": F.col("_fast") - F.col("_slow"),
    })
    wide = with_ewm(wide, {"ind_macd_signal": ("ind_macd", alpha_of_span(9))}, key)
    wide = bollinger(wide, value=value, key=key).withColumns({
        "ind_bbp": F.col("bb_pct"),
        "ind_vol20": F.coalesce(trailing(F.stddev_samp, "_ret", 20, key, 2), F.lit(0.0)),
    })
    names = indicator_names()
    return fill_gaps(wide.select(key, "date", value, *names), names, key)


def indicator_names() -> list[str]:
    return ["ind_ema10", "ind_ema50", "ind_rsi14", "ind_macd", "ind_macd_signal",
            "ind_bbp", "ind_vol20"]
