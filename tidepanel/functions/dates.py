"""Calendar, horizon and clock expressions.

Timestamps are kept without a zone and mean UTC, so no result depends on the
session time zone. ``as_of`` is always passed in; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidepanel import settings as S


def col_of(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_weekday(day) -> Column:
    return F.weekday(col_of(day)) < 5


def to_zone(ts, zone: str) -> Column:
    """UTC wall time -> wall time in ``zone`` (both without a zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col_of(ts).cast("timestamp_ntz"))


def utc_instant(ts) -> Column:
    """Instant of a zone-less UTC time; watermarks need one. Not bound to the session zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, col_of(ts).cast("timestamp_ntz")))


def next_business_days(day, count) -> Column:
    """Array of the ``count`` weekdays strictly after ``day``."""
    day = col_of(day)
    count = F.lit(count) if isinstance(count, int) else col_of(count)
    span = F.sequence(F.date_add(day, 1), F.date_add(day, (count * 2 + 7).cast("int")))
    return F.slice(F.filter(span, lambda d: F.weekday(d) < 5), 1, count)


def business_horizon(steps) -> Column:
    """7 -> 5, 180 -> 126, 365 -> 252, anything else unchanged."""
    steps = col_of(steps)
    out = steps
    for calendar, business in S.HORIZON_BDAYS.items():
        out = F.when(steps == calendar, F.lit(business)).otherwise(out)
    return out.cast("int")


def seasonal_period(steps) -> Column:
    steps = col_of(steps)
    return F.when(steps <= 30, 5).when(steps <= 365, 20).otherwise(252)


def stable_seasonal_period(steps, n_obs) -> Column:
    """5 / 20 / 63 by horizon, never above a third of the history (at least 2)."""
    steps, n_obs = col_of(steps), col_of(n_obs)
    base = F.when(steps <= 30, 5).when(steps <= 180, 20).otherwise(63)
    third = F.floor(n_obs / 3).cast("int")
    return F.least(base, F.greatest(F.lit(2), third))


def history_period(model, steps) -> Column:
    """Look-back period string by model and horizon."""
    model, steps = F.lower(col_of(model)), col_of(steps)
    return (
        F.when(model == "lstm", "10y")
        .when(steps <= 7, "6mo")
        .when(steps <= 180, "2y")
        .when(steps <= 365, "5y")
        .otherwise("10y")
    )


def chart_period(model, steps) -> Column:
    """History shown next to a forecast."""
    steps = col_of(steps)
    return (
        F.when(steps == 7, "7d")
        .when(steps == 180, "6mo")
        .when(steps == 365, "1y")
        .otherwise(history_period(model, steps))
    )


def period_start(last_day, period) -> Column:
    """Day after which a period string such as ``6mo``, ``2y`` or ``7d`` reaches back."""
    last_day, period = col_of(last_day), col_of(period)
    n = F.regexp_extract(period, r"^(\d+)", 1).try_cast("int")
    return (
        F.when(period.endswith("mo"), F.add_months(last_day, -n))
        .when(period.endswith("y"), F.add_months(last_day, -12 * n))
        .otherwise(F.date_sub(last_day, n))
    )


def second_of_day(ts) -> Column:
    ts = col_of(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def market_open(ts, force: bool = False) -> Column:
    """New York weekday with 09:30:00 <= time <= 16:00:00, bounds included."""
    if force:
        return F.lit(True)
    local = to_zone(ts, S.MARKET_TZ)
    micros = F.date_part(F.lit("SECOND"), local)
    clock = F.hour(local) * 3600 + F.minute(local) * 60 + micros
    return is_weekday(local) & clock.between(9 * 3600 + 30 * 60, 16 * 3600)


def last_cutoff(as_of, hour: int, minute: int, zone: str = S.LOCAL_TZ) -> Column:
    """Latest daily cutoff at or before ``as_of``; local wall time."""
    local = to_zone(as_of, zone)
    today = (
        F.date_trunc("day", local).cast("timestamp_ntz")
        + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(0))
    )
    return F.when(local >= today, today).otherwise(
        today - F.make_dt_interval(F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    )


def is_stale(updated_at, as_of, hour: int, minute: int, zone: str = S.LOCAL_TZ) -> Column:
    """Updated before the last cutoff; a missing time is stale."""
    return F.coalesce(
        to_zone(updated_at, zone) < last_cutoff(as_of, hour, minute, zone), F.lit(True)
    )


def snapshot_stale(updated_at, as_of, zone: str = S.LOCAL_TZ) -> Column:
    """Last update on an earlier local date than ``as_of``."""
    return F.coalesce(
        to_zone(updated_at, zone).cast("date") < to_zone(as_of, zone).cast("date"), F.lit(True)
    )
