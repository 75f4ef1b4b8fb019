"""Readers and shape helpers for incoming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidepanel.functions.dates import period_start
from tidepanel.functions.scalars import day_or_null, number_or, safe_name
from tidepanel.sources import schemas
from tidepanel.sources.writers import ends_path

# fixed values: spellings of column names that are unified
RENAMED = {"adj close": "Adj Close", "adj_close": "Adj Close", "close": "Close"}


class EmptySource(RuntimeError):
    """A required source has no rows."""


class MissingColumn(KeyError):
    """A required column is not in the source."""


def flatten_names(names: list) -> list[str]:
    """Join multi-level names with ``_`` and unify the spelling of close columns."""
    flat = ["_".join(str(x) for x in n if x not in ("", None)) if isinstance(n, tuple) else n
            for n in names]
    return [RENAMED.get(n, n) for n in flat]


def with_flat_names(df: DataFrame) -> DataFrame:
    return df.toDF(*flatten_names(df.columns))


def pick_close(names: list[str]) -> str | None:
    """The close-like column, one that is not adjusted first."""
    like = [n for n in names if "close" in n.lower()]
    plain = [n for n in like if "adj" not in n.lower()]
    return (plain or like or [None])[0]


def pick_value(df: DataFrame) -> str:
    """``Close``, else the first numeric column, else the first column."""
    if "Close" in df.columns:
        return "Close"
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return (numeric or df.columns)[0]


def exog_columns(df: DataFrame) -> list[str]:
    """External regressors of a market table."""
    return [c for c in df.columns
            if c not in ("date", "symbol", "close") and not c.startswith("ind_")]


def feature_columns(model: str, df: DataFrame) -> list[str]:
    """External columns for the exogenous model, these and the indicators for the
    learned one, none for the rest."""
    if model == "sarimax":
        return exog_columns(df)
    if model == "lstm":
        return exog_columns(df) + [c for c in df.columns if c.startswith("ind_")]
    return []


def require_rows(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise EmptySource(f"no rows in {name}")
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return (reader.schema(schema) if schema is not None else reader).load(path)


def close_table(df: DataFrame, symbol: str | None = None, out: str = "close") -> DataFrame:
    """(symbol, date, close) from a price table with any usual column spelling.

    Bad dates are dropped, bad numbers become null (and are filled on alignment).
    """
    df = with_flat_names(df)
    value = pick_close(df.columns)
    if value is None:
        raise MissingColumn(f"no close-like column in {df.columns}")
    day = next((c for c in df.columns if c.lower() in ("date", "datetime")), None)
    if day is None:
        raise MissingColumn(f"no date column in {df.columns}")
    name = F.lit(symbol) if symbol else F.col(next(c for c in df.columns if c.lower() == "symbol"))
    date = F.col(day).cast("date") if df.schema[day].dataType != T.StringType() else day_or_null(day)
    return df.select(
        name.alias("symbol"), date.alias("date"), number_or(value, None).alias(out)
    ).where(F.col("date").isNotNull())


def exog_table(df: DataFrame, code: str) -> DataFrame:
    return close_table(df, symbol=safe_name(code), out="value").withColumnRenamed("symbol", "code")


def read_market(spark: SparkSession, path: str) -> DataFrame:
    """The stored market table without its partition column."""
    return spark.read.parquet(path).drop("month")


def read_symbol(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Rows of one symbol, any case, from the stored market table.

    The spellings of the name come from the table of ends (a row per symbol), so that the scan gets equal values to
    compare its row groups with.
    """
    ends = spark.read.parquet(ends_path(path))
    names = [r[0] for r in ends.where(F.lower("symbol") == symbol.lower()).select("symbol").collect()]
    return read_market(spark, path).where(F.col("symbol").isin(names))


def read_period(spark: SparkSession, path: str, period: str) -> DataFrame:
    """Rows after ``last date - period`` of each series, from the stored market table.

    Only months that some series needs are scanned: they are found in the table of ends and reach the scan as a value
    of the running query, whatever the number of series.
    """
    starts = spark.read.parquet(ends_path(path)).select(
        "symbol", "last_date", period_start(F.col("last_date"), F.lit(period)).alias("_start"))
    months = starts.select(F.explode(F.sequence(
        F.trunc("_start", "month"), F.trunc("last_date", "month"), F.expr("interval 1 month"))).alias("m"))
    wanted = months.agg(F.collect_set("m")).scalar()
    rows = spark.read.parquet(path).where(F.array_contains(wanted, F.col("month")))
    return rows.join(starts.drop("last_date"), "symbol").where(F.col("date") > F.col("_start")).drop("_start", "month")


def market_symbol(market: DataFrame, symbol: str) -> DataFrame:
    """Rows of one symbol, any case and any spelling of the columns."""
    named = market.toDF(*[c.lower() for c in market.columns])
    return named.where(F.lower("symbol") == symbol.lower())


def between_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """start <= date < end."""
    return df.where((F.col("date") >= F.lit(start).cast("date"))
                    & (F.col("date") < F.lit(end).cast("date")))


def wide_close(df: DataFrame, symbols: list[str], key: str = "symbol",
               value: str = "close") -> DataFrame:
    """One column per listed symbol, one row per date."""
    return df.groupBy("date").pivot(key, symbols).agg(F.first(value, ignorenulls=True))


def statement_table(financials: DataFrame) -> DataFrame:
    """Long statement rows -> (symbol, date, revenue, net_income)."""
    return (
        financials.groupBy("symbol", F.col("fiscal_date").alias("date"))
        .pivot("metric", ["Total Revenue", "Net Income"])
        .agg(F.first("value", ignorenulls=True))
        .withColumnsRenamed({"Total Revenue": "revenue", "Net Income": "net_income"})
    )


def articles_from_feed(feed: DataFrame) -> DataFrame:
    """Nested news answers -> one row per article."""
    return feed.select(F.explode("articles").alias("a")).select(
        F.col("a.publishedAt").try_cast("timestamp_ntz").alias("published"),
        F.col("a.title").alias("title"),
        F.col("a.description").alias("description"),
        F.col("a.url").alias("url"),
    )


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return articles_from_feed(
        spark.read.schema(schemas.NEWS_FEED).option("multiLine", "true").json(path))
