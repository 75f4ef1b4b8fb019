"""Business-day alignment.

A series is a key (``symbol`` or ``code``) with at most one row per date. That
is the size bound behind every per-key window of this package: however many raw
rows a key has, :func:`daily_mean` folds them map-side to one row per day, and a
century has 26,000 weekdays. Grids are built by expanding each observation up to
the next one, so no calendar table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidepanel.functions.dates import is_weekday


def series(key: str = "symbol", order: str = "date"):
    return W.partitionBy(key).orderBy(order)


def so_far(key: str = "symbol"):
    return series(key).rowsBetween(W.unboundedPreceding, W.currentRow)


def whole(key: str = "symbol"):
    return series(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def backwards(key: str = "symbol"):
    """Running frame from the newest row; a frame that ends at the last row
    would be evaluated again for every row."""
    return (W.partitionBy(key).orderBy(F.col("date").desc())
            .rowsBetween(W.unboundedPreceding, W.currentRow))


def in_cents(value: str) -> Column:
    """Nearest whole cent; plain arithmetic stays in generated code, decimal rounding would not."""
    return F.floor(F.col(value) * 100 + 0.5)


def daily_mean(df: DataFrame, key: str, ts: str, value: str, *, name: str, out: str) -> DataFrame:
    """One mean per (key, day) from raw rows, in exact cents.

    Integer sums give the same double for every split of the input, and the
    partial sums are built before the shuffle, so one heavy key costs nothing.
    """
    cents = in_cents(value)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(key).cast("string").alias(name), F.col(ts).cast("date").alias("date"))
        .agg((F.sum(cents) / F.count(cents) / 100).alias(out))
    )


def one_per_day(df: DataFrame, key: str = "symbol", value: str = "close",
                order: str | None = None) -> DataFrame:
    """One row per (key, date): the value with the greatest ``order`` (default: the
    value itself). Restores the size bound for sources that repeat days."""
    return df.groupBy(key, "date").agg(F.max_by(value, order or value).alias(value))


def expand(df: DataFrame, key: str, value: str, lo: Column | None = None,
           hi: Column | None = None) -> DataFrame:
    """Every calendar day of each key with the latest weekday value before it.

    ``lo`` / ``hi`` widen all keys to common bounds. Days before the first
    weekday value stay null. The first known value is kept in ``_first`` for a
    back fill without a second window.
    """
    w = series(key)
    seen = F.when(is_weekday("date"), F.col(value))
    start = F.col("date")
    if lo is not None:
        start = F.when(F.col("_prev").isNull(), F.least(lo, F.col("date"))).otherwise(start)
    stop = F.coalesce(F.date_sub(F.col("_next"), 1),
                      F.col("date") if hi is None else F.greatest(hi, F.col("date")))
    marked = df.select(
        key,
        "date",
        F.last(seen, ignorenulls=True).over(so_far(key)).alias("_value"),
        F.first(seen, ignorenulls=True).over(whole(key)).alias("_first"),
        F.lead("date").over(w).alias("_next"),
        F.lag("date").over(w).alias("_prev"),
    )
    days = marked.select(
        key, F.col("date").alias("_seen"), "_value", "_first",
        F.explode(F.sequence(start, stop)).alias("date"),
    )
    known = F.when(F.col("date") >= F.col("_seen"), F.col("_value"))
    return days.select(key, "date", known.alias(value), "_first")


def ensure_business_days(df: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Weekday grid with forward fill only; series that are already regular stay as they are.

    Regularity is decided by aggregates over the same window partition that carries
    the fill, so the series is read and sorted once.
    """
    marked = _with_regularity(df, key)
    seen = F.when(is_weekday("date"), F.col(value))
    w = series(key)
    rows = marked.select(
        key, "date", F.col(value).alias("_own"), "_regular",
        F.last(seen, ignorenulls=True).over(so_far(key)).alias("_value"),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date")).alias("_to"),
    )
    grid = F.filter(F.sequence("date", "_to"), lambda d: F.weekday(d) < 5)
    return rows.select(
        key,
        F.explode(F.when(F.col("_regular"), F.array("date")).otherwise(grid)).alias("day"),
        F.when(F.col("_regular"), F.col("_own")).otherwise(F.col("_value")).alias(value),
    ).withColumnRenamed("day", "date").select(key, "date", value)


def _with_regularity(df: DataFrame, key: str) -> DataFrame:
    """``_regular``: the dates follow one frequency, which is a constant step, all
    weekdays, or every n-th month start / month end. Under three dates never do."""
    w = series(key)
    steps = df.withColumns({
        "_gap": F.datediff("date", F.lag("date").over(w)),
        "_months": (F.year("date") * 12 + F.month("date"))
        - F.lag(F.year("date") * 12 + F.month("date")).over(w),
    })
    wd = F.weekday("date")
    on_weekdays = (wd < 5) & (F.col("_gap").isNull()
                              | (F.col("_gap") == F.when(wd == 0, 3).otherwise(1)))
    p = W.partitionBy(key)

    def same(c: str) -> Column:
        return F.min(c).over(p) == F.max(c).over(p)

    anchored = (F.min(F.dayofmonth("date") == 1).over(p)
                | F.min(F.last_day("date") == F.col("date")).over(p))
    regular = (F.count("date").over(p) >= 3) & (
        same("_gap") | F.min(on_weekdays).over(p) | (same("_months") & anchored))
    return steps.withColumn("_regular", F.coalesce(regular, F.lit(False))).drop("_gap", "_months")


def regular_series(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Keys whose dates follow one frequency."""
    return _with_regularity(df.select(key, "date"), key).where("_regular").select(key).distinct()


def align_business_days(df: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Weekday grid per key, forward fill, then back fill of a leading gap."""
    return (
        expand(df, key, value)
        .where(is_weekday("date"))
        .select(key, "date", F.coalesce(value, "_first").alias(value))
    )


def ingest_prices(df: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Aligned panel as it is stored: a series without any value holds 0."""
    return align_business_days(df, key, value).withColumn(value, F.coalesce(value, F.lit(0.0)))


def _ends(df: DataFrame) -> Column:
    """First and last date as one value of the running query."""
    return df.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()


def align_to_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """All keys on the weekday grid between the overall first and last date.

    Equals a full outer merge of the keys on the date followed by forward and
    back fill, in one shuffle by key.
    """
    ends = _ends(df)
    return (
        expand(df, key, value, ends["lo"], ends["hi"])
        .where(is_weekday("date"))
        .select(key, "date", F.coalesce(value, "_first", F.lit(0.0)).alias(value))
    )


def align_to_union(df: DataFrame, key: str = "symbol", value: str = "close") -> DataFrame:
    """Every key on every date that any key has; last value carried, lead = first value."""
    dates = df.select("date").distinct()
    ends = _ends(dates)
    lo, hi = ends["lo"], ends["hi"]
    w = series(key)
    first = F.lag("date").over(w).isNull()
    spans = df.select(
        key, F.col(value),
        F.when(first, lo).otherwise(F.col("date")).alias("_from"),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), hi).alias("_to"),
    )
    days = spans.select(key, F.explode(F.sequence("_from", "_to")).alias("date"), value)
    # a row per date: the series stay where they are
    return days.join(F.broadcast(dates), "date", "left_semi").select(key, "date", value)


def forward_fill(df: DataFrame, cols: list[str], key: str = "symbol") -> DataFrame:
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far(key)) for c in cols})


def back_fill(df: DataFrame, cols: list[str], key: str = "symbol") -> DataFrame:
    return df.withColumns({c: F.last(c, ignorenulls=True).over(backwards(key)) for c in cols})


def fill_gaps(df: DataFrame, cols: list[str], key: str = "symbol") -> DataFrame:
    """Forward fill, back fill, then 0, in one window stage.

    Only a leading gap is left after the forward fill, so its back fill is the
    first known value of the series.
    """
    return df.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(so_far(key)),
                      F.first(c, ignorenulls=True).over(whole(key)), F.lit(0.0))
        for c in cols
    })
