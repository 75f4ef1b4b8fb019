"""Scalar expressions: cleaning, names, text, colours and forecast arithmetic."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from tidepanel.functions.dates import col_of

# fixed values: characters replaced in exogenous column names
NAME_REPLACEMENTS = [("=", "_"), ("^", "IDX_"), ("-", "_"), ("/", "_"), (" ", "_")]


def finite(x) -> Column:
    """NaN and infinities become null."""
    x = col_of(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number_or(x, default: float | None = 0.0) -> Column:
    """Numeric coercion; what does not parse (or is not finite) becomes ``default``."""
    value = finite(col_of(x).try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(default))


def day_or_null(x) -> Column:
    """Date coercion; bad dates become null."""
    return col_of(x).try_cast("date")


def safe_name(name: str) -> str:
    return functools.reduce(lambda s, r: s.replace(*r), NAME_REPLACEMENTS, name).lower()


def safe_name_col(x) -> Column:
    out = col_of(x)
    for old, new in NAME_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.lower(out)


def change_pct(now, before) -> Column:
    """(now - before) / before in percent; null when ``before`` is 0 or missing."""
    now, before = col_of(now), col_of(before)
    return F.try_divide(now - before, before) * 100


def present(x) -> Column:
    """0 counts as missing, as an empty quote does."""
    x = col_of(x)
    return F.when(x != 0, x)


def change_colour(pct) -> Column:
    """Green above or at zero, red below; darker up to a move of 3 percent."""
    pct = col_of(pct)
    light = 50 - F.least(F.abs(pct), F.lit(3.0)) / 3 * 30
    hue = F.when(pct >= 0, 120).otherwise(0)
    return F.format_string("hsl(%d, 80%%, %.1f%%)", hue, light)


def billions(x) -> Column:
    return F.round(col_of(x) / 1e9, 2)


def shown(x, digits: int = 2) -> Column:
    """0 for missing, then rounded."""
    return F.round(F.coalesce(col_of(x), F.lit(0.0)), digits)


def article_text(title, description) -> Column:
    return F.concat_ws(
        " ", F.coalesce(col_of(title), F.lit("")), F.coalesce(col_of(description), F.lit(""))
    )


def clip(x, bound) -> Column:
    bound = F.lit(bound) if isinstance(bound, (int, float)) else col_of(bound)
    x = col_of(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, bound), -bound))


def blend(r, drift, step, total, weight) -> Column:
    """Pull a step towards the drift; the pull grows linearly up to ``weight``."""
    w = F.lit(weight) * col_of(step) / col_of(total)
    return (1 - w) * col_of(r) + w * col_of(drift)


def block_days(block, blocks, horizon, agg_step: int) -> Column:
    """Days of 1-based ``block``; the last block takes what is left."""
    block, blocks, horizon = col_of(block), col_of(blocks), col_of(horizon)
    return F.when(block < blocks, F.lit(agg_step)).otherwise(horizon - agg_step * (blocks - 1))


def spread_block(block_log_return, days) -> Column:
    """Even simple return per day of a block log return."""
    return F.expm1(col_of(block_log_return) / F.greatest(F.lit(1), col_of(days)))


def map_lookup(key, table: dict, default) -> Column:
    """Literal dictionary with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col_of(key)), F.lit(default))


def price_pairs(day, price) -> Column:
    """Aggregate: ordered ``[{date, price}]`` with two decimals."""
    pairs = F.array_sort(F.collect_list(F.struct(col_of(day).alias("d"), col_of(price).alias("p"))))
    return F.transform(
        pairs,
        lambda x: F.struct(
            F.date_format(x["d"], "yyyy-MM-dd").alias("date"), F.round(x["p"], 2).alias("price")
        ),
    )
