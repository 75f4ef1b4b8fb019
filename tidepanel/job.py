"""Command line for spark-submit.

    job.py ingest   --prices IN --exog-path IN --out OUT [--tickers A,B] (default all) [--exog CL=F,XLU]
                    [--period 5y] [--format parquet]
    job.py forecast --market IN --tables OUT --as-of '2024-01-31 12:30:00'
                    [--models arima,sarima] [--steps 7,180]
"""

from __future__ import annotations

import argparse
import re

from pyspark.sql import DataFrame, functions as F

from tidepanel import settings as S
from tidepanel.functions.scalars import safe_name_col
from tidepanel.operators import calendar as cal, market
from tidepanel.operators.rolling import period_slice
from tidepanel.plans.nightly import POINT_KEY, nightly
from tidepanel.session import build_session
from tidepanel.sources import schemas
from tidepanel.sources.merge import BucketTable
from tidepanel.sources.readers import close_table, read_table, require_rows
from tidepanel.sources.writers import write_exog, write_market


def names(text: str) -> list[str]:
    return [x for x in re.split(r"[,\s]+", text) if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidepanel")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("--prices", required=True)
    one.add_argument("--exog-path")
    one.add_argument("--out", required=True)
    one.add_argument("--tickers", type=names, default=["all"])
    one.add_argument("--exog", type=names, default=list(S.EXOG_CODES.values()))
    one.add_argument("--period", default="5y")
    one.add_argument("--format", default="parquet")
    two = sub.add_parser("forecast")
    two.add_argument("--market", required=True)
    two.add_argument("--tables", required=True)
    two.add_argument("--as-of", required=True)
    two.add_argument("--models", type=names, default=S.MODELS)
    two.add_argument("--steps", type=lambda t: [int(x) for x in names(t)],
                     default=list(S.HORIZON_BDAYS))
    return top


def ingest(prices: DataFrame, exog: DataFrame | None, out: str, codes: list[str], period: str) -> None:
    """Price rows (symbol, date, close) and exog rows (code, date, value) -> stored tables.

    The stored market table is what all later jobs read, so the raw files are
    passed once.
    """
    require_rows(prices, "prices")
    wide = None
    if exog is not None and codes:
        market.require_codes(require_rows(exog, "exog"), codes)
        wide = market.exog_wide(
            period_slice(cal.one_per_day(exog, "code", "value"), period, "code"), codes)
        write_exog(wide, f"{out}/exog.parquet")
        wide = prices.sparkSession.read.parquet(f"{out}/exog.parquet")
    panel = cal.ingest_prices(period_slice(cal.one_per_day(prices), period))
    write_market(market.market_table(panel, wide), f"{out}/market.parquet")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"tidepanel-{args.command}")
    if args.command == "ingest":
        raw = read_table(spark, args.prices, args.format)
        prices = close_table(raw)
        if [t.lower() for t in args.tickers] != ["all"]:
            prices = prices.where(F.lower("symbol").isin([t.lower() for t in args.tickers]))
        exog = None
        if args.exog_path:
            exog = read_table(spark, args.exog_path, args.format).select(
                F.col("code").cast("string"), F.col("date").cast("date").alias("date"),
                F.col("value").cast("double").alias("value")).where(
                F.lower(safe_name_col("code")).isin([market.safe_name(c) for c in args.exog]))
        ingest(prices, exog, args.out, args.exog, args.period)
        return
    table = read_table(spark, args.market).drop("month")
    runs = BucketTable(spark, f"{args.tables}/forecast_runs", schemas.FORECAST_RUNS, POINT_KEY)
    points = BucketTable(spark, f"{args.tables}/forecast_points", schemas.FORECAST_POINTS, POINT_KEY, order=None)
    status = nightly(table, runs, points, args.as_of, models=args.models, steps=args.steps)
    stamp = re.sub("[^0-9]", "", args.as_of)  # a run that is repeated takes its own place
    status.withColumn("as_of", F.lit(args.as_of)).write.mode("overwrite").parquet(f"{args.tables}/forecast_status/run={stamp}")


if __name__ == "__main__":
    main()
