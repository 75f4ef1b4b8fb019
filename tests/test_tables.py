import datetime as dt
import json

import pytest
from conftest import values
from pyspark.sql import functions as F, types as T

from tidepanel import settings as S
from tidepanel.functions import scalars as X
from tidepanel.plans import arima, evaluate, news, refresh, views
from tidepanel.session import fresh_path, shared_folder, written
from tidepanel.sources import merge, readers, schemas, writers
from tidepanel.streaming import live


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


# ---- names, columns, coercion -----------------------------------------------
def test_flatten_names():
    assert readers.flatten_names([("Close", "AEP"), ("Date", ""), "adj_close", "close"]) == [
        "Close_AEP", "Date", "Adj Close", "Close"]


def test_pick_close():
    assert readers.pick_close(["Adj Close", "Close", "Open"]) == "Close"
    assert readers.pick_close(["Open", "Adj Close"]) == "Adj Close"
    assert readers.pick_close(["Open"]) is None


def test_pick_value_and_feature_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "name string, n int, v double")
    assert readers.pick_value(df) == "n"
    assert readers.pick_value(df.withColumnRenamed("v", "Close")) == "Close"
    wide = spark.range(1).select(*[F.lit(1.0).alias(c) for c in (
        "date", "symbol", "close", "cl_f", "ind_rsi14")])
    assert readers.feature_columns("sarimax", wide) == ["cl_f"]
    assert readers.feature_columns("lstm", wide) == ["cl_f", "ind_rsi14"]
    assert readers.feature_columns("arima", wide) == []
    assert writers.ordered_columns(wide.select("cl_f", "close", "symbol", "date")).columns == [
        "date", "symbol", "close", "cl_f"]


def test_close_table_coerces(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "1.5"), ("2024-01-03", "n/a"), ("bad", "3")], "Date string, close string")
    got = readers.close_table(raw, "AEP").orderBy("date").collect()
    assert [tuple(r) for r in got] == [("AEP", dt.date(2024, 1, 2), 1.5), ("AEP", dt.date(2024, 1, 3), None)]
    with pytest.raises(readers.MissingColumn):
        readers.close_table(raw.drop("close"), "AEP")
    assert readers.exog_table(raw, "CL=F").first()["code"] == "cl_f"


def test_required_rows(spark):
    empty = spark.createDataFrame([], schemas.PRICES)
    with pytest.raises(readers.EmptySource):
        readers.require_rows(empty, "prices")
    assert readers.require_rows(spark.range(1), "x").count() == 1


def test_safe_names(spark):
    for raw, good in {"CL=F": "cl_f", "^GSPC": "idx_gspc", "BRK-B": "brk_b", "A/B c": "a_b_c"}.items():
        assert X.safe_name(raw) == good
        assert one(spark, X.safe_name_col(F.lit(raw))) == (good,)


def test_numbers(spark):
    got = one(spark, X.number_or(F.lit("x")), X.number_or(F.lit("2.5")),
              X.number_or(F.lit(float("inf"))), X.number_or(F.lit(float("nan")), None),
              X.day_or_null(F.lit("nope")), X.clip(F.lit(None).cast("double"), 0.1))
    assert got == (0.0, 2.5, 0.0, None, None, None)


@pytest.mark.parametrize("pct,colour", [
    (3.0, "hsl(120, 80%, 20.0%)"), (-1.5, "hsl(0, 80%, 35.0%)"),
    (0.0, "hsl(120, 80%, 50.0%)"), (10.0, "hsl(120, 80%, 20.0%)")])
def test_colour(spark, pct, colour):
    assert one(spark, X.change_colour(F.lit(pct))) == (colour,)


def test_blend_and_blocks(spark):
    got = one(spark, X.blend(F.lit(0.1), F.lit(0.0), F.lit(5), F.lit(10), 0.2),
              X.block_days(F.lit(26), F.lit(26), F.lit(126), 5),
              X.block_days(F.lit(1), F.lit(26), F.lit(126), 5),
              X.spread_block(F.log(F.lit(1.21)), F.lit(2)))
    assert got[0] == pytest.approx(0.09) and got[1:3] == (1, 5) and got[3] == pytest.approx(0.1)


def test_text_and_maps(spark):
    got = one(spark, X.article_text(F.lit(None).cast("string"), F.lit("b")), X.billions(F.lit(1.235e9)),
              X.map_lookup(F.lit("EIX"), S.EXCHANGES, S.DEFAULT_EXCHANGE),
              X.map_lookup(F.lit("nope"), S.EXCHANGES, S.DEFAULT_EXCHANGE))
    assert got[0] == " b" and got[2:] == ("NYSE", "NASDAQ")


def test_pairs_json(make_prices):
    df = make_prices({"S": [("2024-01-03", 2.345), ("2024-01-02", 1)]})
    text = views.pairs_json(df, ["symbol"]).first()["pairs"]
    assert json.loads(text) == [{"date": "2024-01-02", "price": 1.0}, {"date": "2024-01-03", "price": 2.35}]


# ---- files ------------------------------------------------------------------
def _stored_market(spark):
    """Three symbols over four years, one of which ends a year before the others."""
    days = spark.sql("select explode(sequence(date'2020-01-01', date'2023-12-31', interval 1 day)) as date")
    rows = days.select(F.explode(F.array(*map(F.lit, ("AEP", "DUK", "old")))).alias("symbol"), "date",
                       F.dayofyear("date").cast("double").alias("close")).where("symbol <> 'old' or date < '2023-01-01'")
    path = fresh_path(spark, "m")
    writers.write_market(rows.withColumn("oil", F.lit(3.0)), path)
    return path


def test_market_round_trip(spark, tmp_path):
    path = _stored_market(spark)
    back = readers.read_symbol(spark, path, "duk")
    assert back.columns == ["date", "symbol", "close", "oil"] and back.count() == 1461
    assert "In(symbol, [DUK])" in back._jdf.queryExecution().executedPlan().toString() or "EqualTo(symbol,DUK)" in (
        back._jdf.queryExecution().executedPlan().toString())
    assert readers.read_symbol(spark, path, "none").collect() == []
    assert readers.market_symbol(readers.read_market(spark, path), "aep").count() == 1461
    ends = {r["symbol"]: (r["first_date"], r["last_date"], r["n"]) for r in spark.read.parquet(writers.ends_path(path)).collect()}
    assert ends["old"] == (dt.date(2020, 1, 1), dt.date(2022, 12, 31), 1096)
    exog = spark.createDataFrame([("2024-01-02", 1.0)], "date string, oil double")
    writers.write_exog(exog, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


def test_a_period_reads_its_months(spark):
    path = _stored_market(spark)
    got = readers.read_period(spark, path, "2mo")
    counts = {r["symbol"]: (r["lo"], r["hi"], r["n"]) for r in got.groupBy("symbol").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n")).collect()}
    assert counts == {s: (dt.date(y, 11, 1), dt.date(y, 12, 31), 61) for s, y in (("AEP", 2023), ("DUK", 2023), ("old", 2022))}
    whole = scanned(spark.read.parquet(path))
    part = scanned(got)  # with the scan of the ends, which has no partitions
    assert whole["numPartitions"] == 48 and part["numPartitions"] == 6 and part["filesSize"] < whole["filesSize"] / 3


def test_reports_and_appended_metrics(spark):
    metrics = spark.createDataFrame([("AEP", 7, "arima", 1.0, 2.0)],
                                    "symbol string, steps int, model string, mae double, rmse double")
    rows = evaluate.experiment_rows(metrics, "b1", epochs=60, notes="x")
    path = fresh_path(spark, "metrics")
    for _ in range(2):
        writers.append_metrics(rows, path, "2024-01-01 00:00:00")
    back = spark.read.option("header", "true").csv(path)
    assert back.columns == S.METRIC_COLUMNS and back.count() == 2
    first = back.first()
    assert (first["ticker"], first["MAE$"], first["epochs"], first["val_split"]) == ("AEP", "1.0", "60", None)
    writers.write_report(metrics, path + "j", "json")
    assert spark.read.json(path + "j").count() == 1


def test_written_reads_back(spark):
    df = written(spark.range(5), "ids")
    assert df.count() == 5 and shared_folder(spark) in df.inputFiles()[0]


def test_news_feed(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"status": "ok", "articles": [
        {"publishedAt": "2024-01-02T03:04:05", "title": "AEP up", "description": None, "url": "u1"},
        {"publishedAt": "2024-01-03T00:00:00", "title": "nothing", "description": "the SOUTHERN Company", "url": "u2"}]}))
    arts = readers.read_news(spark, str(tmp_path))
    got = news.relevant(arts, S.COMPANY_NAMES).orderBy("url").collect()
    assert [(r["symbol"], r["url"], r["text"]) for r in got] == [
        ("AEP", "u1", "AEP up "), ("SO", "u2", "nothing the SOUTHERN Company")]


def test_statement_table(spark):
    rows = [("A", dt.date(2023, 1, 1), "Total Revenue", 5.0), ("A", dt.date(2023, 1, 1), "Net Income", -1.0),
            ("A", dt.date(2022, 1, 1), "Total Revenue", 0.0)]
    table = readers.statement_table(spark.createDataFrame(rows, schemas.FINANCIALS))
    assert values(table, "revenue", "net_income") == [(0.0, None), (5.0, -1.0)]
    assert views.financials_trend(table).count() == 1


def test_wide_close(make_prices):
    df = make_prices({"A": [("2024-01-02", 1)], "B": [("2024-01-03", 2)]})
    assert values(readers.wide_close(df, ["A", "B"]), "A", "B") == [(1.0, None), (None, 2.0)]


# ---- merge ------------------------------------------------------------------
RUN = "symbol string, model string, steps int, backtest_mae double, last_price double, updated_at timestamp_ntz"


def _runs(spark, *rows):
    return spark.createDataFrame(
        [(s, m, 7, e, 1.0, dt.datetime(2024, 1, d)) for s, m, e, d in rows], RUN)


KEY = ["symbol", "model", "steps"]


def _run_table(spark, path=None, **options):
    return merge.BucketTable(spark, path or fresh_path(spark, "runs"), schemas.FORECAST_RUNS, options.pop("key", KEY), **options)


def test_upsert_twice(spark):
    table = _run_table(spark)
    assert table.batches() == [] and table.read().count() == 0
    table.write(_runs(spark, ("A", "arima", 1.0, 1), ("B", "arima", 2.0, 1)))
    new = _runs(spark, ("A", "arima", 5.0, 2), ("C", "arima", 3.0, 2))
    table.write(new)
    table.write(new)
    got = {r["symbol"]: r["backtest_mae"] for r in table.read().collect()}
    assert got == {"A": 5.0, "B": 2.0, "C": 3.0}
    table.write(_runs(spark, ("A", "arima", 9.0, 1)))  # older than what is stored
    assert {r["symbol"]: r["backtest_mae"] for r in table.read().collect()}["A"] == 5.0
    table.write(_runs(spark, ("A", "arima", 6.0, 2)))  # equal time: the later batch
    assert table.lookup(symbol="A", model="arima", steps=7).first()["backtest_mae"] == 6.0


def test_replayed_batch_changes_nothing(spark):
    table = _run_table(spark)
    first, later = _runs(spark, ("A", "arima", 1.0, 1)), _runs(spark, ("A", "arima", 7.0, 3))
    for batch in (first, first, later, first):
        table.write(batch)
    assert [r["backtest_mae"] for r in table.read().collect()] == [7.0]
    table.write(_runs(spark, ("A", "arima", 8.0, 4)), 4, "q")
    table.write(_runs(spark, ("A", "arima", 8.0, 4)), 4, "q")
    assert len(table.batches()) == 5 and table.read().count() == 1


def test_a_batch_writes_and_a_lookup_reads_one_bucket(spark, tmp_path):
    table = _run_table(spark, str(tmp_path / "t"), buckets=8)
    table.write(_runs(spark, *[(f"S{i}", "arima", float(i), 1) for i in range(200)]))
    table.write(_runs(spark, ("S7", "arima", 70.0, 2)))
    folders = [sorted(p.name for p in (tmp_path / "t" / f"batch={n}").glob("bucket=*")) for n in table.batches()]
    assert len(folders[0]) == 8 and len(folders[1]) == 1
    found = table.lookup(symbol="S7", model="arima", steps=7)
    assert [r["backtest_mae"] for r in found.collect()] == [70.0]
    assert scanned(found)["numPartitions"] == 2  # its bucket in either batch
    assert table.lookup(symbol="none", model="arima", steps=7).collect() == []


def scanned(df):
    """Metrics of the only file scan of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node)
        if node.nodeName() in ("AdaptiveSparkPlan",):
            todo.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    totals = {}
    for node in found:
        metrics = node.metrics()
        for name in ("numFiles", "numPartitions", "filesSize", "numOutputRows"):
            if metrics.contains(name):
                totals[name] = totals.get(name, 0) + metrics.apply(name).value()
    return totals


def test_writers_do_not_meet(spark):
    path = fresh_path(spark, "runs")
    one, two = _run_table(spark, path), _run_table(spark, path)
    name = one._next()
    two.write(_runs(spark, ("B", "arima", 2.0, 1)))  # between the choice of a name and the write
    one._store(_runs(spark, ("A", "arima", 1.0, 1)), name)
    assert {r["symbol"] for r in one.read().collect()} == {"A", "B"}


def test_folds_keep_rows_and_late_batches(spark, tmp_path):
    table = _run_table(spark, str(tmp_path / "t"), buckets=4)
    for day in range(1, 5):
        table.write(_runs(spark, ("A", "arima", float(day), day), (f"S{day}", "arima", 0.5, day)))
    late = table._next()
    before = sorted(map(tuple, table.read().collect()))
    table.fold()
    assert len(table.batches()) == 1 and sorted(map(tuple, table.read().collect())) == before
    assert len(list((tmp_path / "t").glob("batch=*"))) == 5  # running readers still find theirs
    table._store(_runs(spark, ("A", "arima", 9.0, 9)), late)  # began before the fold
    assert table.lookup(symbol="A", model="arima", steps=7).first()["backtest_mae"] == 9.0
    table.fold()
    assert len(list((tmp_path / "t").glob("batch=*"))) == 3 and table.read().count() == 5
    table.fold()
    assert len(table.batches()) == 1


def test_half_written_batches_and_folds_are_ignored(spark, tmp_path):
    table = _run_table(spark, str(tmp_path / "t"))
    table.write(_runs(spark, ("A", "arima", 1.0, 1)))
    table.write(_runs(spark, ("B", "arima", 1.0, 1)))
    (tmp_path / "t" / "batch=0000000007-x").mkdir()  # a crashed write has no success marker
    spark.createDataFrame([(n,) for n in table.batches()], "name string").write.parquet(
        str(tmp_path / "t" / "_folded" / (table.batches()[-1] + "+")))  # a fold that ended before its rows
    assert len(table.batches()) == 2 and table.read().count() == 2
    assert table._next().startswith("0000000008-")


def test_replace_group(spark):
    table = _run_table(spark, key=["symbol"], order=None)
    table.write(_runs(spark, ("A", "arima", 1.0, 1), ("A", "lstm", 1.0, 1), ("B", "arima", 1.0, 1)))
    table.write(_runs(spark, ("A", "sarima", 2.0, 2)))
    table.write(_runs(spark))  # nothing is replaced by nothing
    got = sorted((r["symbol"], r["model"]) for r in table.read().collect())
    assert got == [("A", "sarima"), ("B", "arima")]
    table.fold()
    assert sorted((r["symbol"], r["model"]) for r in table.read().collect()) == got


def test_a_failed_backtest_is_not_stored(spark):
    part = "struct<date:date,actual:double>"
    rows = [("A", "arima", 7, "backtest", "error", "short", None, None, 1.0), ("A", "arima", 7, "future", "ok", None, [1.0], [], 1.0),
            ("B", "arima", 7, "backtest", "ok", None, [1.0], [(None, 3.0)], 1.0), ("B", "arima", 7, "future", "ok", None, [1.0], [], 1.0)]
    fits = spark.createDataFrame(rows, "symbol string, model string, steps int, kind string, status string, error string, "
                                 f"path array<double>, test array<{part}>, last_price double")
    got = refresh.run_rows(fits, "2024-01-01 00:00:00").collect()
    assert [(r["symbol"], r["backtest_mae"]) for r in got] == [("B", 2.0)]
    assert {r["symbol"]: r["status"] for r in refresh.status_rows(fits).collect()} == {"A": "error", "B": "ok"}


# ---- refresh ----------------------------------------------------------------
def test_eligibility_and_history(make_prices):
    df = make_prices({"A": [("2024-01-02", 5), ("2024-01-03", 0.9)], "B": [("2024-01-02", 2)]})
    tasks = refresh.eligible_tasks(df)
    assert {r["symbol"] for r in tasks.collect()} == {"B"} and tasks.count() == 12
    rows = refresh.history_check(df, [1, 7]).where("symbol = 'A'").orderBy("steps").collect()
    assert [r["reason"] for r in rows] == ["not enough data", "series too short for the backtest window"]


def test_eligible_tasks_are_keys_only(make_prices):
    tasks = refresh.eligible_tasks(make_prices({"A": [("2024-01-02", 5)], "B": [("2024-01-02", 1)]}), 1.0, ["arima", "lstm"], [7])
    assert tasks.columns == refresh.KEY
    assert sorted(map(tuple, tasks.collect())) == [("A", "arima", 7), ("A", "lstm", 7)]


def test_refresh_plan(spark):
    now = F.lit("2024-01-03 13:00:00").cast("timestamp_ntz")  # cutoff 12:30 UTC
    rows = [("A", "arima", 7, dt.datetime(2024, 1, 3, 12, 31)), ("A", "lstm", 7, dt.datetime(2024, 1, 3, 12, 29))]
    runs = spark.createDataFrame(rows, "symbol string, model string, steps int, updated_at timestamp_ntz")
    grid = arima.work_grid(runs.select("symbol").distinct(), ["arima", "sarima", "lstm"], [7])
    assert {r["model"] for r in refresh.refresh_plan(grid, runs, now).collect()} == {"sarima", "lstm"}
    assert {r["model"] for r in refresh.missing_forecasts(grid, runs).collect()} == {"sarima"}
    assert {r["model"] for r in refresh.stale_runs(runs, now).collect()} == {"lstm"}


# ---- snapshot, views, streams -----------------------------------------------
def _bars(spark, *rows):
    return spark.createDataFrame([(s, dt.datetime.fromisoformat(t), float(o), float(c)) for s, t, o, c in rows],
                                 schemas.BARS)


FACTS = ("symbol string, prev_close double, market_cap double")


def test_snapshot_bases(spark):
    bars = _bars(spark, ("A", "2024-01-10 15:00:00", 10, 11), ("A", "2024-01-10 16:00:00", 11, 12),
                 ("B", "2024-01-10 15:00:00", 10, 9), ("C", "2024-01-10 15:00:00", 4, 5))
    facts = spark.createDataFrame([("A", 8.0, 100.0), ("B", 0.0, None)], FACTS)
    got = {r["symbol"]: r for r in views.live_snapshot(bars, facts).collect()}
    assert (got["A"]["price"], got["A"]["change"], got["A"]["market_cap"]) == (12.0, 50.0, 100)
    assert got["B"]["change"] == -10.0 and got["B"]["market_cap"] is None  # missing cap is kept as null
    assert got["C"]["change"] == 25.0  # no fundamentals at all
    order = [r["symbol"] for r in views.heat_map(views.live_snapshot(bars, facts)).collect()]
    assert order == ["A", "B", "C"]


def test_preview(make_prices):
    df = make_prices({"A": [("2024-01-02", 1), ("2024-01-03", 2), ("2024-01-04", 3)]})
    assert [r["close"] for r in views.preview(df, 2).collect()] == [3.0, 2.0]
    assert [r["close"] for r in views.preview(df, 1, newest=False).collect()] == [1.0]


def test_last_update_is_local(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 9, 20, 0, 0, 700000),)], "last_updated timestamp_ntz")
    assert views.last_update(df).first()[0] == "03:00:00 2024-01-10"


def test_chart_frame_and_forecast_view(spark, weekdays):
    panel = weekdays({"S": [float(i) for i in range(400)]})
    points = spark.createDataFrame(
        [("S", "arima", 180, "future", k, dt.date(2026, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(1, 31)],
        "symbol string, model string, steps int, kind string, step int, date date, price double")
    kept = values(views.chart_points(points), "step")
    assert kept == [1, 8, 15, 22, 29, 30]
    runs = spark.createDataFrame([("S", "arima", 180, 2.0, 50.0)],
                                 "symbol string, model string, steps int, backtest_mae double, last_price double")
    view = views.forecast_view(panel, runs, points, "S", "arima", 180)
    counts = {r["kind"]: r["count"] for r in view.groupBy("kind").count().collect()}
    assert counts == {"historical": 44, "future": 6}
    assert view.first()["backtest_mae_pct"] == 4.0
    frame = views.chart_frame(panel, points, ["arima"])
    assert frame.where("historical is not null and arima is not null").count() == 0


def test_ytd_and_high_low(make_prices):
    df = make_prices({"A": [("2023-12-29", 50), ("2024-01-02", 10), ("2024-03-01", 12)], "B": [("2022-01-03", 1)]})
    got = {r["symbol"]: r["ytd_pct"] for r in views.ytd_change(df, "2024-03-05").collect()}
    assert got == {"A": 20.0, "B": 0.0}
    row = views.high_low(df).where("symbol = 'A'").first()
    assert (row["high_52w"], row["low_52w"]) == (50.0, 10.0)


def test_news_latest_limits_before_the_shuffle(spark):
    rows = [("S", f"t{i}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"u{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, text string, published timestamp_ntz, url string")
    out = news.latest(df)
    assert [r["url"] for r in out.orderBy("place").collect()] == [f"u{i}" for i in range(49, 44, -1)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_live_stream_equals_batch_over_several_files(spark, tmp_path):
    parts = [[("A", "2024-01-10 15:00:00", 10, 11), ("B", "2024-01-10 15:01:00", 5, 5)],
             [("A", "2024-01-10 18:00:00", 12, 13), ("A", "2024-01-10 23:00:00", 99, 99)],
             [("B", "2024-01-11 15:01:00", 6, 7)]]
    facts = spark.createDataFrame([("A", 10.0, 1.0), ("B", 5.0, 2.0)], FACTS)
    source = str(tmp_path / "bars")
    table = merge.BucketTable(spark, str(tmp_path / "stocks"), schemas.STOCKS, ["symbol"], order="last_updated")
    for p in parts:  # each run picks up the new file and goes on from the checkpoint
        _bars(spark, *p).coalesce(1).write.mode("append").parquet(source)
        stream = live.file_stream(spark, source, schemas.BARS)
        live.live_job(stream, facts, table, str(tmp_path / "ckpt")).awaitTermination()
    got = {r["symbol"]: (r["price"], r["change"], r["last_updated"]) for r in table.read().collect()}
    assert got == {"A": (13.0, 30.0, dt.datetime(2024, 1, 10, 18)), "B": (7.0, 40.0, dt.datetime(2024, 1, 11, 15, 1))}
    ends = live.day_ends(_bars(spark, *[r for p in parts for r in p]))
    newest = ends.groupBy("symbol").agg(F.max_by(F.struct("close", "open", "last_ts"), "day").alias("r"))
    batch = views.snapshot_rows(newest.select("symbol", "r.*"), facts)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, table.read().collect()))


def test_news_stream_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "articles")
    arts = [(dt.datetime(2024, 1, 2, 3), "AEP one", "x", "u1"), (dt.datetime(2024, 1, 2, 4), "AEP one", "x", "u1"),
            (dt.datetime(2024, 1, 2, 5), "DUK two", "x", "u2")]
    spark.createDataFrame(arts, schemas.ARTICLES).coalesce(1).write.parquet(source)
    log = merge.BatchLog(spark, str(tmp_path / "news"), schemas.NEWS)
    assert log.read().count() == 0
    live.news_job(live.file_stream(spark, source, schemas.ARTICLES), S.COMPANY_NAMES, log,
                  str(tmp_path / "ckpt"), "2024-02-01 00:00:00").awaitTermination()
    assert sorted((r["symbol"], r["url"]) for r in live.stored_news(log).collect()) == [("AEP", "u1"), ("DUK", "u2")]
    late = [(dt.datetime(2023, 12, 1, 3), "AEP late", "x", "u0")]
    spark.createDataFrame(late, schemas.ARTICLES).coalesce(1).write.mode("append").parquet(source)
    live.news_job(live.file_stream(spark, source, schemas.ARTICLES), S.COMPANY_NAMES, log,
                  str(tmp_path / "ckpt"), "2024-02-02 00:00:00").awaitTermination()
    assert ("AEP", "u0") in {(r["symbol"], r["url"]) for r in live.stored_news(log).collect()}


def test_price_stream_adds_up_over_files(spark, tmp_path):
    source = str(tmp_path / "raw")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.TimestampNTZType()),
                           T.StructField("v", T.DoubleType())])
    log = merge.BatchLog(spark, str(tmp_path / "daily"), live.DAILY_SUMS)
    for v in (1.0, 2.5):
        spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 9), v)], schema).coalesce(1).write.mode(
            "append").parquet(source)
        live.price_job(live.file_stream(spark, source, schema), log, str(tmp_path / "ckpt"),
                       key="k", ts="t", value="v").awaitTermination()
    run = live.query_id(spark, str(tmp_path / "ckpt"))
    log.write(spark.createDataFrame([("A", dt.date(2024, 1, 2), 250, 1)], live.DAILY_SUMS), 1, run)  # again
    got = live.daily_prices(log).collect()
    assert [tuple(r) for r in got] == [("A", dt.date(2024, 1, 2), 1.75)]
    other = str(tmp_path / "later")
    spark.createDataFrame([("A", dt.datetime(2024, 1, 3, 9), 4.0)], schema).coalesce(1).write.parquet(other)
    live.price_job(live.file_stream(spark, other, schema), log, str(tmp_path / "new checkpoint"),
                   key="k", ts="t", value="v").awaitTermination()  # the first query's rows stay
    assert sorted(tuple(r) for r in live.daily_prices(log).collect()) == [
        ("A", dt.date(2024, 1, 2), 1.75), ("A", dt.date(2024, 1, 3), 4.0)]


def test_news_to_fetch_and_rejected_keys(spark):
    news = spark.createDataFrame([("A", dt.datetime(2024, 1, 19, 12, 0)), ("B", dt.datetime(2024, 1, 19, 11, 59))],
                                 "symbol string, updated_at timestamp_ntz")
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    now = F.lit("2024-01-20 11:00:00").cast("timestamp_ntz")  # 18:00 in Bangkok; the cutoff is 12:00 UTC of the day before
    assert {r["symbol"] for r in refresh.news_to_fetch(symbols, news, now).collect()} == {"B", "C"}


def test_codes_without_rows_are_an_error(spark):
    from tidepanel.operators import market

    exog = spark.createDataFrame([("cl_f", 1.0)], "code string, value double")
    assert market.require_codes(exog, ["CL=F"]) is exog
    with pytest.raises(readers.EmptySource, match="xlu"):
        market.require_codes(exog, ["CL=F", "XLU"])


def test_refresh_stream_plans_each_cutoff_once(spark, tmp_path):
    """Prices over several runs of one query: the keys of a closed cutoff are those of the batch plan."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.TimestampNTZType()),
                           T.StructField("v", T.DoubleType())])
    at = dt.datetime
    files = [[("A", at(2024, 1, 2, 12, 29), 5.0), ("B", at(2024, 1, 2, 9), 7.0), ("low", at(2024, 1, 2, 9), 0.5)],
             [("A", at(2024, 1, 2, 12, 31), 6.0), ("B", at(2024, 1, 3, 10), 8.0)],
             [("C", at(2024, 1, 5, 13), 3.0)],  # closes the cutoffs of 2 and 3 January
             [("A", at(2024, 1, 2, 10), 99.0), ("C", at(2024, 1, 5, 13), 3.0)]]  # late, and nothing new
    runs = _run_table(spark)
    runs.write(_runs(spark, ("A", "arima", 1.0, 2)).withColumn("updated_at", F.lit(at(2024, 1, 3, 12, 30)).cast("timestamp_ntz")))
    prices = merge.BucketTable(spark, str(tmp_path / "last"), live.LAST_PRICES, ["symbol"], order="last_ts")
    todo = merge.BucketTable(spark, str(tmp_path / "todo"), live.TODO, KEY, order="cutoff")
    source, written_ = str(tmp_path / "raw"), []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        live.refresh_job(live.file_stream(spark, source, schema), prices, runs, todo, str(tmp_path / "ckpt"), key="k", ts="t",
                         value="v", models=["arima", "sarima"], steps=[7]).awaitTermination()
        written_.append(len(todo.batches()))
    assert written_[1] == 0 and written_[3] == written_[2]
    cut = dt.datetime(2024, 1, 3, 12, 30)
    assert {(r["symbol"], r["close"]) for r in prices.read().collect()} == {("A", 6.0), ("B", 8.0), ("low", 0.5)}
    closes = spark.createDataFrame([("A", 6.0, 1), ("B", 8.0, 1), ("low", 0.5, 1)], "symbol string, close double, date int")
    plan = refresh.refresh_plan(refresh.eligible_tasks(closes, 1.0, ["arima", "sarima"], [7]), runs.read(), F.lit(cut).cast("timestamp_ntz"))
    got = {(r["symbol"], r["model"], r["steps"], r["cutoff"]) for r in todo.read().collect()}
    assert got == {(*r, cut) for r in plan.collect()} == {("A", "sarima", 7, cut), ("B", "arima", 7, cut), ("B", "sarima", 7, cut)}
    runs.write(_runs(spark, ("B", "arima", 1.0, 4)))
    assert {tuple(r) for r in live.due(todo, runs).collect()} == {("A", "sarima", 7), ("B", "sarima", 7)}
