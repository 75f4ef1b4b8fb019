"""Input tables of the application, derived from the given tables.

Every function reads the parquet files; the SQL text beside it is the same table
for the comparison engine. Prices are means in exact cents, so both engines
start from the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators import calendar as cal
from tidepanel.operators.rolling import with_returns
from workload.registry import part


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- daily prices: one series per order priority ----------------------------
def prices(spark, folder) -> DataFrame:
    return cal.daily_mean(table(spark, folder, "orders"), "o_orderpriority", "o_orderdate",
                          "o_totalprice", name="symbol", out="close")


part("prices", """
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100 AS close
  FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2""")


# ---- many sparse series: one per supplier -----------------------------------
def supplier_prices(spark, folder) -> DataFrame:
    return cal.daily_mean(table(spark, folder, "lineitem"), "l_suppkey", "l_shipdate",
                          "l_extendedprice", name="symbol", out="close")


part("supplier_prices", """
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100 AS close
  FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2""")


def _grid(source: str) -> str:
    return f"""
  SELECT b.symbol, g.date, o.close AS c FROM (
    SELECT symbol, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                               INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT symbol, MIN(date) AS lo, MAX(date) AS hi FROM {source} GROUP BY 1)) g
  JOIN (SELECT DISTINCT symbol FROM {source}) b ON b.symbol = g.symbol
  LEFT JOIN {source} o ON o.symbol = g.symbol AND o.date = g.date
  WHERE isodow(g.date) < 6"""


def _ensured(grid: str) -> str:
    return f"""
  SELECT symbol, date, LAST_VALUE(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM {grid}"""


def _panel(ensured: str) -> str:
    return f"""
  SELECT symbol, date, COALESCE(close, FIRST_VALUE(close IGNORE NULLS) OVER (PARTITION BY symbol
    ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS close
  FROM {ensured}"""


part("grid", _grid("prices"), "prices")
part("ensured", _ensured("grid"), "grid")
part("panel", _panel("ensured"), "ensured")
part("supplier_grid", _grid("supplier_prices"), "supplier_prices")
part("supplier_ensured", _ensured("supplier_grid"), "supplier_grid")
part("supplier_panel", _panel("supplier_ensured"), "supplier_ensured")


def panel(spark, folder) -> DataFrame:
    return cal.align_business_days(prices(spark, folder))


def supplier_panel(spark, folder) -> DataFrame:
    return cal.align_business_days(supplier_prices(spark, folder))


def returns(spark, folder) -> DataFrame:
    return with_returns(panel(spark, folder))


def _rets(panel: str) -> str:
    return f"""
  SELECT symbol, date, close,
    close / NULLIF(LAG(close) OVER w, 0) - 1 AS ret,
    close - LAG(close) OVER w AS diff,
    CASE WHEN close > 0 AND LAG(close) OVER w > 0 THEN LN(close) - LN(LAG(close) OVER w) END AS log_ret,
    ROW_NUMBER() OVER w AS rn, COUNT(*) OVER (PARTITION BY symbol) AS n
  FROM {panel} WINDOW w AS (PARTITION BY symbol ORDER BY date)"""


part("rets", _rets("panel"), "panel")
part("supplier_rets", _rets("supplier_panel"), "supplier_panel")


# ---- exogenous series: one per return flag ----------------------------------
EXOG_CODES = ["A", "N", "R"]


def exog(spark, folder) -> DataFrame:
    return cal.daily_mean(table(spark, folder, "lineitem"), "l_returnflag", "l_shipdate",
                          "l_extendedprice", name="code", out="value")


part("exog", """
  SELECT l_returnflag AS code, CAST(l_shipdate AS DATE) AS date,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100 AS value
  FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2""")
part("exog_long", """
  SELECT code, date, COALESCE(LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    FIRST_VALUE(v IGNORE NULLS) OVER (PARTITION BY code ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS value
  FROM (SELECT c.code, g.date, e.value AS v FROM (
      SELECT CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                         INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT MIN(date) AS lo, MAX(date) AS hi FROM exog)) g
    CROSS JOIN (SELECT DISTINCT code FROM exog) c
    LEFT JOIN exog e ON e.code = c.code AND e.date = g.date
    WHERE isodow(g.date) < 6)""", "exog")
part("exog_wide", """
  SELECT date, MAX(CASE WHEN code = 'A' THEN value END) AS a,
         MAX(CASE WHEN code = 'N' THEN value END) AS n, MAX(CASE WHEN code = 'R' THEN value END) AS r
  FROM exog_long GROUP BY 1""", "exog_long")


# ---- intraday bars, fundamentals, statements, news --------------------------
def bars(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("open"), F.col("value").alias("close"))


part("bars", "SELECT event_type AS symbol, ts, value AS open, value AS close FROM events")

# fixed values: which market segment stands for which bar symbol; one is left without
SEGMENT_SYMBOL = {"AUTOMOBILE": "click", "BUILDING": "error", "FURNITURE": "purchase",
                  "HOUSEHOLD": "signup", "MACHINERY": "view"}


def fundamentals(spark, folder) -> DataFrame:
    cents = F.sum(cal.in_cents("c_acctbal"))
    n = F.count("c_acctbal")
    seg = F.col("c_mktsegment")
    pairs = F.create_map(*[F.lit(x) for kv in SEGMENT_SYMBOL.items() for x in kv])
    return (
        table(spark, folder, "customer").groupBy("c_mktsegment")
        .agg(cents.cast("double").alias("cents"), n.alias("n"))
        .select(
            F.try_element_at(pairs, seg).alias("symbol"), seg.alias("segment"),
            (F.col("cents") / F.col("n") / 1000000).alias("dividend_yield"),
            F.when(seg != "HOUSEHOLD", F.col("cents") / F.col("n") / 100000).alias("trailing_pe"),
            F.when(seg != "MACHINERY", F.col("cents") / F.col("n") / 300000).alias("beta"),
            (F.col("n") / 100).alias("price_to_book"),
            (F.col("n") * 10.0).alias("avg_volume"),
            F.when(seg != "FURNITURE", F.col("cents") / 100).alias("market_cap"),
            F.when(seg == "BUILDING", F.lit(0.0)).when(
                seg != "AUTOMOBILE", F.col("cents") / F.col("n") / 10000).alias("prev_close"),
        )
    )


part("fundamentals", """
  SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'click' WHEN 'BUILDING' THEN 'error'
      WHEN 'FURNITURE' THEN 'purchase' WHEN 'HOUSEHOLD' THEN 'signup' WHEN 'MACHINERY' THEN 'view' END AS symbol,
    c_mktsegment AS segment, cents / n / 1000000 AS dividend_yield,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN cents / n / 100000 END AS trailing_pe,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN cents / n / 300000 END AS beta,
    n / 100 AS price_to_book, n * 10.0::DOUBLE AS avg_volume,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN cents / 100 END AS market_cap,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 WHEN c_mktsegment <> 'AUTOMOBILE' THEN cents / n / 10000 END AS prev_close
  FROM (SELECT c_mktsegment, CAST(SUM(CAST(ROUND(c_acctbal * 100) AS BIGINT)) AS DOUBLE) AS cents,
               CAST(COUNT(c_acctbal) AS DOUBLE) AS n FROM customer GROUP BY 1)""")


def financials(spark, folder) -> DataFrame:
    """Yearly revenue and net income per order priority, long."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    price = cal.in_cents("l_extendedprice")
    keep = 100 - cal.in_cents("l_discount")
    sums = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderpriority").alias("symbol"),
                 F.trunc(F.col("o_orderdate").cast("date"), "year").alias("fiscal_date"))
        .agg((F.sum(price) / 100).alias("revenue"), (F.sum(price * keep) / 10000).alias("income"))
    )
    rows = F.array(F.struct(F.lit("Total Revenue").alias("metric"), F.col("revenue").alias("value")),
                   F.struct(F.lit("Net Income").alias("metric"), F.col("income").alias("value")))
    return sums.select("symbol", "fiscal_date", F.inline(rows))


part("statement_sums", """
  SELECT o_orderpriority AS symbol, CAST(date_trunc('year', o_orderdate) AS DATE) AS date,
    CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue,
    CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)
             * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) AS DOUBLE) / 10000 AS net_income
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")


def headline() -> list:
    """First line as title, everything after it as description (null for a single line)."""
    end = F.instr("text", "\n")
    rest = F.when(end > 0, F.substring(F.col("text"), end + 1, F.length("text")))
    return [F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"), rest.alias("description")]


def articles(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select(
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"), F.lit(0))
         ).alias("published"),
        *headline(), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("url"))


part("articles", """
  SELECT TIMESTAMP '2024-01-01' + INTERVAL (doc_id) MINUTE AS published,
    string_split(text, chr(10))[1] AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END AS description,
    source || '/' || CAST(doc_id AS VARCHAR) AS url FROM documents""")

# fixed values: (ticker, company name) whose letters occur in the given texts
ALIASES = {"Is": "thble", "Thnt": "thtion", "Anat": "thing", "Ores": "ouand", "Zqx": "thanth"}
