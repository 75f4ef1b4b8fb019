import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_prices(spark):
    """{symbol: [(day, close), ...]} -> prices frame."""
    def make(table, value="close", key="symbol"):
        rows = [(s, d if isinstance(d, dt.date) else dt.date.fromisoformat(d),
                 None if x is None else float(x)) for s, xs in table.items() for d, x in xs]
        return spark.createDataFrame(rows, f"{key} string, date date, {value} double")
    return make


@pytest.fixture
def line(make_prices):
    """Series of consecutive days from 2024-01-01 (a Monday) with the given values."""
    def make(values, symbol="S"):
        start = dt.date(2024, 1, 1)
        return make_prices({symbol: [(start + dt.timedelta(days=i), v)
                                     for i, v in enumerate(values)]})
    return make


@pytest.fixture
def weekdays(make_prices):
    """Series on consecutive weekdays from 2024-01-01."""
    def make(table):
        out = {}
        for symbol, values in table.items():
            day, rows = dt.date(2024, 1, 1), []
            for v in values:
                while day.weekday() > 4:
                    day += dt.timedelta(days=1)
                rows.append((day, v))
                day += dt.timedelta(days=1)
            out[symbol] = rows
        return make_prices(out)
    return make


def values(df, *cols, order=("date",)):
    rows = df.orderBy(*order).select(*cols).collect()
    return [r[0] for r in rows] if len(cols) == 1 else [tuple(r) for r in rows]
