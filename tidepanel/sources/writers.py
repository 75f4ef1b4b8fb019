"""Writers. No write gathers rows into one task; file sizes are left to AQE."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel import settings as S


def ordered_columns(df: DataFrame, base=("date", "symbol", "close")) -> DataFrame:
    return df.select(*base, *[c for c in df.columns if c not in base])


def write_market(df: DataFrame, path: str) -> None:
    """Market table by month, inside a month ranged and sorted by symbol.

    The number of folders is that of the months, not of the series; files are as large as adaptive execution makes
    them, and the row groups of a sorted file rule out other symbols. Beside it (``ends_path``) lies a row per symbol with its
    first and last date, from which readers find the months of a look-back without scanning.
    """
    rows = ordered_columns(df).withColumn("month", F.trunc("date", "month"))
    (rows.repartitionByRange("month", "symbol").sortWithinPartitions("month", "symbol", "date")
     .write.mode("overwrite").partitionBy("month").parquet(path))
    stored = df.sparkSession.read.parquet(path)
    (stored.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                  F.count("*").alias("n"))
     .write.mode("overwrite").parquet(ends_path(path)))


def ends_path(path: str) -> str:
    return path.rstrip("/").removesuffix(".parquet") + "_ends.parquet"


def write_exog(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path))


def metric_rows(df: DataFrame, as_of) -> DataFrame:
    """Metric rows in the fixed column list; absent settings are empty strings."""
    have = set(df.columns)
    stamp = F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    cols = []
    for name in S.METRIC_COLUMNS:
        if name in have:
            col = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        elif name == "timestamp_utc":
            col = stamp
        else:
            col = F.lit("")
        cols.append(col.alias(name))
    return df.select(*cols)


def append_metrics(df: DataFrame, path: str, as_of) -> None:
    metric_rows(df, as_of).write.mode("append").option("header", "true").csv(path)
