"""Table schemas. Times are without a zone and mean UTC."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_S, _D, _I, _X, _TS = (T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType(),
                       T.TimestampNTZType())

PRICES = _schema(("symbol", _S), ("date", _D), ("close", _X))
EXOG = _schema(("code", _S), ("date", _D), ("value", _X))
BARS = _schema(("symbol", _S), ("ts", _TS), ("open", _X), ("close", _X))
FUNDAMENTALS = _schema(
    ("symbol", _S), ("dividend_yield", _X), ("trailing_pe", _X), ("beta", _X),
    ("price_to_book", _X), ("high_52w", _X), ("low_52w", _X), ("avg_volume", _X),
    ("market_cap", _X), ("prev_close", _X),
)
FINANCIALS = _schema(("symbol", _S), ("fiscal_date", _D), ("metric", _S), ("value", _X))
ARTICLES = _schema(("published", _TS), ("title", _S), ("description", _S), ("url", _S))
PARAMS = _schema(("symbol", _S), ("model", _S), ("p", _I), ("d", _I), ("q", _I),
                 ("sp", _I), ("sd", _I), ("sq", _I), ("m", _I))
STOCKS = _schema(("symbol", _S), ("price", _X), ("change", _X), ("market_cap", T.LongType()),
                 ("bg_color", _S), ("last_updated", _TS))
FORECAST_RUNS = _schema(("symbol", _S), ("model", _S), ("steps", _I), ("backtest_mae", _X),
                        ("last_price", _X), ("updated_at", _TS))
FORECAST_POINTS = _schema(("symbol", _S), ("model", _S), ("steps", _I), ("kind", _S),
                          ("step", _I), ("date", _D), ("price", _X))
NEWS_FEED = _schema(
    ("status", _S),
    ("articles", T.ArrayType(_schema(
        ("publishedAt", _S), ("title", _S), ("description", _S), ("url", _S)))),
)
NEWS = _schema(("symbol", _S), ("text", _S), ("published", _TS), ("url", _S),
               ("updated_at", _TS))
