"""Running aggregates over buckets equal plain windows, and values that are not numbers break no comparison."""

from __future__ import annotations

import random

import pytest
from helpers import SF, plain
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantspark.operators.asof import asof
from quantspark.operators.fills import history_features, match_fills
from quantspark.operators.ledger import average_cost, equity_curve, running_ledger
from quantspark.operators.risk import drawdown_breaker, evaluate_risk
from quantspark.operators.scan import blocks, prefix_scan
from quantspark.operators.validate import validate_bars
from quantspark.sources.bars import number_bars, read_bars

NAN = float("nan")


def windows_of(df):
    """Keys of the windows in a plan, as text."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "windowspecdefinition" in line]


@pytest.mark.parametrize("kind", ["sum", "max", "min", "last"])
@pytest.mark.parametrize("exclusive", [False, True])
def test_scan_equals_a_window(spark, kind, exclusive):
    """One symbol with gaps and nulls, a null key, buckets of three."""
    rng = random.Random(7)
    rows = [("A", p, rng.choice([None, float(rng.randrange(100))])) for p in sorted(rng.sample(range(200), 120))] + [(None, p, float(-p)) for p in range(5)] + [("B", 0, None)]
    df = spark.createDataFrame(rows, "symbol string, at long, v double").repartition(5)
    frame = W.partitionBy("symbol").orderBy("at").rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    plain = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
    got = prefix_scan(df, ["symbol"], ["at"], blocks(F.col("at"), 3, 5), {"run": (kind, F.col("v"))}, exclusive)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("run", plain("v").over(frame)).collect()))


def test_places_beyond_the_blocks_fail(spark):
    df = spark.createDataFrame([("A", 9, 1.0)], "symbol string, at long, v double")
    with pytest.raises(Exception, match="place beyond"):
        prefix_scan(df, ["symbol"], ["at"], blocks(F.col("at"), 3, 2), {"run": ("sum", F.col("v"))}).collect()


def fills_of(spark, n=160):
    rng = random.Random(2)
    rows = [("r", "A", rng.randrange(60), k, rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 4)), float(rng.randrange(50, 150)), 1.0) for k in range(n)]
    return spark.createDataFrame(rows, "run_id string, symbol string, bar_seq long, order_key long, side string, quantity double, fill_price double, commission double").repartition(6)


def bars_of(spark, n=70):
    rng = random.Random(3)
    rows = [("A", k, 100.0, 101.0 + rng.random(), 98.0 + rng.random(), 99.0 + rng.random()) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, bar_seq long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds("bar_seq")).repartition(3)


def test_ledger_of_one_symbol_in_small_buckets(spark):
    fills, bars = fills_of(spark), bars_of(spark)
    w = W.partitionBy("run_id", "symbol").orderBy("bar_seq", "order_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    q = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    want = fills.withColumns({"cash": F.lit(1000.0) - F.sum(q * F.col("fill_price") + 1.0).over(w), "position": F.sum(q).over(w)})
    key = lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
    small = running_ledger(fills, 1000.0, 3, 5)
    assert key(small, "order_key", "cash", "position") == key(want, "order_key", "cash", "position")
    assert key(running_ledger(fills, 1000.0), "order_key", "cash", "position") == key(want, "order_key", "cash", "position")
    curve = lambda *a: key(equity_curve(fills, bars, 1000.0, *a), "bar_seq", "cash", "position", "net_liquidation")
    assert curve(3, 4) == curve()
    last = max(want.collect(), key=lambda r: (r.bar_seq, r.order_key))
    assert curve()[-1][1:3] == (last.cash, last.position)
    whole, cut = average_cost(fills).first(), average_cost(fills, 2, 3, 6).first()
    assert whole.position == cut.position == last.position and abs((whole.avg_cost or 0) - (cut.avg_cost or 0)) < 1e-9


def test_history_in_small_buckets(spark):
    bars = bars_of(spark)
    w = W.partitionBy("symbol").orderBy("bar_seq")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    want = bars.select("bar_seq", F.count("*").over(past).alias("n"), F.max("high").over(past).alias("h"), F.min("low").over(past).alias("l"), F.round(F.avg("close").over(w.rowsBetween(-5, -1)), 9).alias("m"))
    for bucket, levels in ((3, 4), (7, 3), (1 << 16, 2)):
        got = history_features(bars, 5, bucket, levels).select("bar_seq", "n_seen", "high_seen", "low_seen", F.round("mean_close", 9))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), bucket


def test_no_window_by_symbol_alone(spark):
    fills, bars = fills_of(spark), bars_of(spark)
    for df in (running_ledger(fills), equity_curve(fills, bars), history_features(bars), number_bars(bars.drop("bar_seq")), average_cost(fills)):
        found = windows_of(df)
        assert found and all("_k" in line for line in found)
    arrays = average_cost(fills)._jdf.queryExecution().optimizedPlan().toString()
    assert arrays.count("collect_list") >= 5  # each for a bounded part


def test_numbers_of_bars(spark, tmp_path):
    rows = [("A", t) for t in (-86401.0, -1.0, 0.0, 5.0, 5.5, 86400.0, 1e9, 4e9)] + [("B", 7.0)]
    df = spark.createDataFrame(rows, "symbol string, s double").select("symbol", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "s").repartition(4)
    assert [r.s for r in number_bars(df).filter("symbol = 'A'").orderBy("bar_seq").collect()] == sorted(t for s, t in rows if s == "A")
    assert sorted(r.bar_seq for r in number_bars(df).collect()) == [0, *range(8)]
    for name in ("b", "a"):
        (tmp_path / "in" / "symbol=A").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "symbol=A" / f"{name}.csv").write_text("timestamp,open,high,low,close\n" + "".join(f"{t},{k},1,1,1\n" for k, t in enumerate(["5", "", "NaN", "5", "1e300", "-1e300"])))
    got = read_bars(spark, str(tmp_path / "in")).orderBy("bar_seq").collect()
    assert [r.bar_seq for r in got] == list(range(12))
    assert [str(r.ts_epoch_s) for r in got] == ["None"] * 2 + ["-1e+300"] * 2 + ["5.0"] * 4 + ["1e+300"] * 2 + ["nan"] * 2
    assert [r.open for r in got if r.ts_epoch_s == 5.0] == [0.0, 3.0, 0.0, 3.0]  # by file, then in the file's order


def test_bars_that_are_not_numbers(spark):
    rows = [("A", 0, 1.0, 10.0, 12.0, NAN, 11.0), ("A", 1, 2.0, 10.0, NAN, 8.0, 11.0), ("A", 2, 3.0, NAN, 12.0, 8.0, 11.0), ("A", 3, NAN, 10.0, 12.0, 8.0, 11.0), ("A", 4, 4.0, 10.0, 12.0, 8.0, 11.0), ("A", 5, NAN, 10.0, 12.0, 8.0, 11.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, ts_epoch_s double, open double, high double, low double, close double")
    got = {(r.bar_index, r.code) for r in validate_bars(df).collect()}
    assert got == {(0, "open_outside"), (0, "close_outside"), (1, "open_outside"), (1, "close_outside"), (2, "open_outside")}


def test_risk_of_values_that_are_not_numbers(spark):
    schema = "run_id string, seq long, side string, quantity double, position double, px double, net_liquidation double, gross_position_value double, maint_margin_req double"
    rows = [("r", 1, "BUY", 1.0, 0.0, 10.0, NAN, 100.0, 1.0), ("r", 2, "BUY", 1.0, 0.0, 10.0, 5000.0, NAN, NAN), ("r", 3, "BUY", 1.0, 0.0, 10.0, 3000.0, 1.0, 1.0), ("r", 4, "BUY", NAN, 0.0, 10.0, 5000.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    assert {r.seq: r.reason for r in evaluate_risk(df).collect()} == {1: None, 2: None, 3: "max_daily_loss exceeded (circuit breaker)", 4: None}
    assert {r.seq: (r.session_start, r.tripped) for r in drawdown_breaker(df.filter("seq < 4")).collect()} == {1: (None, False), 2: (5000.0, False), 3: (5000.0, True)}


def test_fills_at_prices_that_are_not_numbers(spark):
    bars = spark.createDataFrame([("A", 0, 10.0, NAN, NAN), ("A", 1, 10.0, 12.0, 8.0)], "symbol string, bar_seq long, open double, high double, low double").withColumn("ts", F.timestamp_seconds("bar_seq"))
    orders = [(1, "BUY", "LMT", NAN, None), (2, "SELL", "STP", None, NAN), (3, "SELL", "LMT", 11.0, None), (4, "BUY", "LMT", 9.0, None), (5, "BUY", "STPLMT", NAN, 11.0)]
    df = spark.createDataFrame([(k, "A", s, 1.0, t, lim, st, 0) for k, s, t, lim, st in orders], "order_key long, symbol string, side string, quantity double, order_type string, limit_price double, stop_price double, submit_seq long")
    assert {r.order_key: r.bar_seq for r in match_fills(df, bars).collect()} == {3: 1, 4: 1}


@pytest.mark.parametrize("tolerance", [None, 10.0])
def test_null_keys_match_nothing(spark, tolerance):
    at = lambda rows, cols: spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds("ts"))
    left = at([(1, None, 5), (2, "A", 5)], "id long, symbol string, ts long")
    right = at([(None, 4, 1.0), ("A", 4, 2.0)], "symbol string, ts long, v double")
    assert {r.id: r.v for r in asof(left, right, ["symbol"], "ts", ["v"], tolerance).collect()} == {1: None, 2: 2.0}


def test_tasks_hold_a_bounded_number_of_waiting_orders(spark, monkeypatch):
    """What a task remembers of each order is bounded by the number of orders, not by the bytes of a file."""
    monkeypatch.setattr("quantspark.operators.fills.WAITING", 10, raising=False)
    bars = bars_of(spark)
    orders = spark.range(150).selectExpr("id AS order_key", "'A' AS symbol", "CASE WHEN id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side", "1.0D AS quantity", "CASE WHEN id % 3 = 0 THEN 'MKT' ELSE 'LMT' END AS order_type", "100.0D + id % 5 - 2 AS limit_price", "CAST(NULL AS DOUBLE) AS stop_price", "id % 60 AS submit_seq")
    out = match_fills(orders.coalesce(1), bars)
    assert "RepartitionByExpression [order_key" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ", 10\n" in plan
    own = bars.select(F.col("symbol").alias("s"), "bar_seq", "low", "high")
    fits = F.expr("s = symbol AND bar_seq >= submit_seq AND CASE WHEN order_type = 'MKT' THEN bar_seq = submit_seq WHEN side = 'BUY' THEN low <= limit_price ELSE high >= limit_price END")
    want = orders.join(own, fits).groupBy("order_key").agg(F.min("bar_seq"))
    assert sorted(map(tuple, out.select("order_key", "bar_seq").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["e4_average_cost", "d2_ledger_totals", "d3_backtest_summary", "e5_equity_curve", "e3_running_ledger"])
def test_queries_on_fills_part_waiting_orders_by_number(spark, duck, monkeypatch, name):
    """Tasks grow in number with the waiting orders, 100 for each, and the result stays that of the SQL."""
    monkeypatch.setattr("quantspark.operators.fills.WAITING", 100, raising=False)
    found = []
    monkeypatch.setattr("quantspark.operators.fills.match_fills", lambda *a, **costs: found.append(match_fills(*a, **costs)) or found[-1])
    query, sql = entry.PLANS[name]
    out = query(spark, SF)
    plan = found[0]._jdf.queryExecution().optimizedPlan().toString()
    parted = [int(line.rsplit(", ", 1)[1]) for line in plan.split("\n") if "RepartitionByExpression [order_key" in line]
    waiting = duck.execute("SELECT count(*) FROM events WHERE event_id // 20 % 4 <> 0").fetchone()[0]
    assert parted == [-(-waiting // 100)] * 2  # the orders and what they touch first
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert plain(out.select(*names).collect()) == plain(want.fetchall())
