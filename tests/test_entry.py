"""Contract: registered queries, their SQL twins and the smoke query."""

import glob
import os

import pytest
from conftest import SMALL

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

SAMPLE = ["panel_backfill", "exog_wide", "returns", "rolling_volatility", "describe_prices",
          "return_correlation", "last_close", "news_relevant", "stale_keys"]


def _plain(rows):
    return sorted([tuple("" if v is None else str(v) for v in r) for r in rows])


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_smoke(spark):
    out = entry.entry(spark)
    assert out.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"select {quoted} from ({entry.oracle_sql()[name]})").fetchall()
    assert _plain(got) == _plain(want)
