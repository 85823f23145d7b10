from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quantspark.operators.decisions import enforce_limits, extract_tool_calls, parse_decisions, parse_replies
from quantspark.operators.fills import match_fills
from quantspark.operators.ledger import average_cost, backtest_summary, ledger_totals
from quantspark.operators.validate import validate_bars
from quantspark.functions.text import parse_duration, parse_end
from quantspark.plans.backtest import pandas_signal, run_backtests
from quantspark.sources.bars import merge_backfill, read_bar_store, read_bars, require_columns, write_bar_store, write_bars

#: Bars whose fills are known.
BARS = [(0, 100.0, 105.0, 95.0, 102.0), (1, 102.0, 106.0, 101.0, 104.0), (2, 104.0, 110.0, 103.0, 109.0)]
ORDERS = "order_key long, run_id string, symbol string, side string, quantity double, order_type string, limit_price double, stop_price double, submit_seq long"


def bars_of(spark, rows=BARS, symbol="A"):
    df = spark.createDataFrame([(symbol, *r) for r in rows], "symbol string, bar_seq long, open double, high double, low double, close double")
    return df.withColumn("ts", F.timestamp_seconds("bar_seq"))


def test_reference_fills(spark):
    orders = [(1, "r", "A", "BUY", 1.0, "MKT", None, None, 0), (2, "r", "A", "BUY", 1.0, "LMT", 99.0, None, 0), (3, "r", "A", "BUY", 1.0, "LMT", 1.0, None, 0), (4, "r", "A", "BUY", 1.0, "MKT", None, None, 3)]
    got = match_fills(spark.createDataFrame(orders, ORDERS), bars_of(spark))
    assert {r.order_key: (r.bar_seq, r.fill_price) for r in got.collect()} == {1: (0, 100.0), 2: (0, 99.0)}


def test_summary(spark):
    fills = match_fills(spark.createDataFrame([(1, "r", "A", "BUY", 1.0, "MKT", None, None, 0)], ORDERS), bars_of(spark, BARS[:2]))
    got = backtest_summary(ledger_totals(fills, 1000.0), bars_of(spark, BARS[:2]), 1000.0).first()
    assert (got.end_equity, round(got.return_pct, 6)) == (1004.0, 0.4)


def fill_by_hand(order, bars):
    _, _, symbol, side, _, kind, limit, stop, submit = order
    buy = side == "BUY"
    for s, seq, o, h, low, _ in bars:
        if s != symbol or seq < submit or (kind == "MKT" and seq > submit):
            continue
        at_limit = limit is not None and (low <= limit if buy else h >= limit)
        at_stop = stop is not None and (h >= stop if buy else low <= stop)
        if kind == "MKT":
            return seq, o
        if kind == "LMT" and at_limit or kind == "STPLMT" and at_limit and at_stop:
            return seq, limit
        if kind == "STP" and at_stop:
            return seq, stop
    return None


def test_random_fills(spark):
    rng = random.Random(4)
    bars = []
    for s in "AB":
        px = 100.0
        for k in range(150):
            o = px
            c = round(px + rng.uniform(-2, 2), 2)
            bars.append((s, k, o, round(max(o, c) + rng.random(), 2), round(min(o, c) - rng.random(), 2), c))
            px = c
    orders = []
    for k in range(200):
        kind = rng.choice(["MKT", "LMT", "STP", "STPLMT"])
        orders.append((k, "r", rng.choice("ABC"), rng.choice(["BUY", "SELL"]), 1.0, kind, round(rng.uniform(85, 115), 2) if "LMT" in kind else None, round(rng.uniform(85, 115), 2) if "ST" in kind else None, rng.randrange(152)))
    df = spark.createDataFrame(bars, "symbol string, bar_seq long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds("bar_seq"))
    got = {r.order_key: (r.bar_seq, r.price) for r in match_fills(spark.createDataFrame(orders, ORDERS), df, block=16).collect()}
    assert got == {o[0]: f for o in orders if (f := fill_by_hand(o, bars))}


FILLS = "run_id string, symbol string, bar_seq long, order_key long, side string, quantity double, fill_price double"


@pytest.mark.parametrize("bars", [1, 3, 64])
def test_average_cost(spark, bars):
    steps = [(1, 10), (1, 20), (-1, 30), (-3, 40), (-1, 50), (3, 1)]
    want = [10.0, 15.0, 15.0, 15.0, 80 / 3, None]
    rows = [(f"r{n}", "A", k, k, "BUY" if q > 0 else "SELL", float(abs(q)), float(px)) for n in range(1, 7) for k, (q, px) in enumerate(steps[:n])]
    got = average_cost(spark.createDataFrame(rows, FILLS), bars)
    found = {r.run_id: r.avg_cost for r in got.collect()}
    assert [found[f"r{n}"] and round(found[f"r{n}"], 9) for n in range(1, 7)] == [w and round(w, 9) for w in want]


def test_average_cost_over_many_stretches(spark):
    rng = random.Random(3)
    rows = [("r", s, k // 3, k, rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 4)), float(rng.randrange(50, 150))) for s in "ABCD" for k in range(400)]
    want = {}
    for _, s, _, _, side, n, px in rows:
        qty, cost = want.get(s, (0.0, None))
        q = n if side == "BUY" else -n
        if qty + q == 0:
            cost = None
        elif qty * q >= 0:
            cost = (abs(qty) * (cost or 0.0) + n * px) / abs(qty + q)
        want[s] = qty + q, cost
    got = {r.symbol: (r.position, r.avg_cost) for r in average_cost(spark.createDataFrame(rows, FILLS).repartition(7), 4).collect()}
    assert {s: (q, c and round(c, 6)) for s, (q, c) in got.items()} == {s: (q, c and round(c, 6)) for s, (q, c) in want.items()}


@pytest.mark.parametrize("bucket", [1, 2, 1 << 16])
def test_validate_bars_messages(spark, bucket):
    rows = [("A", 0, 5.0, 1.0, 2.0, 1.0, 1.0), ("A", 1, 4.0, 1.0, 0.5, 1.0, None), ("A", 2, None, None, None, None, None), ("A", 3, None, -1.0, 2.0, 1.0, 1.0), ("A", 4, 5.0, 1.0, 2.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, bar_index long, ts_epoch_s double, open double, high double, low double, close double")
    got = {(r.bar_index, r.message) for r in validate_bars(df, spark.createDataFrame([("A",), ("Z",)], "symbol string"), bucket).collect()}
    assert got == {(1, "timestamps not sorted at bar[1]"), (1, "bar[1] missing close"), (1, "bar[1] low > high"), (1, "bar[1] open outside [low,high]"), (2, "bar[2] missing timestamp"), (3, "bar[3] missing timestamp"), (3, "duplicate timestamp at bar[3]"), (4, "bar[4] non-positive low=0.0"), (4, "bar[4] close outside [low,high]"), (4, "duplicate timestamp at bar[4]"), (-1, "no bars")}


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_text("timestamp,open,high,low,close,volume,extra\n3,1,2,0.5,1,null,x\n2025-01-01T00:00:00Z,1,2,0.5,1,7,x\n1,1,2,0.5,1,,x\n")
    got = read_bars(spark, str(tmp_path / "in.csv"), "A").orderBy("bar_seq").collect()
    assert [(r.ts_epoch_s, r.volume, r.bar_seq) for r in got] == [(1.0, None, 0), (3.0, None, 1), (1735689600.0, 7.0, 2)]
    write_bars(read_bars(spark, str(tmp_path / "in.csv"), "A"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").rglob("*.csv")))
    assert "timestamp,open,high,low,close,volume" in text and "1,1.0,2.0,0.5,1.0,\n" in text
    try:
        require_columns(["timestamp"])
        raise AssertionError
    except ValueError:
        pass


def test_backfill_keeps_first_seen(spark):
    rows = [("A", t, p, k, float(t * 10 + p)) for p, ts in enumerate([(3, 4), (2, 3), (1, 2)]) for k, t in enumerate(ts)]
    got = merge_backfill(spark.createDataFrame(rows, "symbol string, ts long, page_no int, ingest_seq long, close double"))
    assert sorted((r.ts, r.close) for r in got.collect()) == [(1, 12.0), (2, 21.0), (3, 30.0), (4, 40.0)]


def test_decisions(spark):
    place = '{"action":"PLACE","order":{"instrument":{"kind":"STK","symbol":"AAPL"},"side":"BUY","qty":"1.5","type":"MKT"}}'
    raws = [
        (1, '{"decisions":[' + place + ',{"action":"CANCEL","order_id":"123"}]}'), (2, '```json\n{"decisions":[{"action":"cancel","order_id":1}]}\n```'), (3, '{"decisions":[{"action":"CANCEL","order_id":"1"},{"action":"CANCEL","order_id":"2"}]}'),
        (4, "not json"), (5, "[]"), (6, "{}"), (7, '{"decisions":[{"action":"CANCEL","order_id":" "},7]}'), (8, '{"decisions":[{"action":"PLACE","order":{}}]}'), (9, '{"decisions":[]}'), (10, None),
    ]
    out = parse_decisions(spark.createDataFrame(raws, "resp_id long, raw string"))
    got = {}
    for r in out.collect():
        got.setdefault(r.resp_id, []).append((r.action, r.order_id, r.quantity, r.response_error))
    assert sorted(got[1], key=str) == [("CANCEL", "123", None, None), ("PLACE", None, 1.5, None)]
    assert got[2] == [("CANCEL", "1", None, None)] and len(got[3]) == 2
    errors = {k: v[0][3] for k, v in got.items()}
    assert errors[4] == "LLM output is not valid JSON" and errors[5] == "LLM output must be a JSON object" and errors[6] == "LLM output must contain 'decisions' list"
    assert errors[7] == "CANCEL requires order_id" and errors[8] == "order.instrument must be an object" and errors[9] is None
    verdicts = {r.resp_id: r.verdict for r in enforce_limits(out, ["STK"], ["AAPL"], 1, 5.0).collect()}
    assert verdicts[2] is None and verdicts[3] == "LLM produced too many decisions: 2 > 1"


def test_replies_and_calls(spark):
    raws = [(1, "hello"), (2, '{"assistant_message":"m","tool_calls":[{"name":"x","args":{"a":1},"id":5},{"name":" "},3]}'), (3, "[1]"), (4, None)]
    got = {r.reply_id: (r.message, r["name"], r.args, r.call_id) for r in parse_replies(spark.createDataFrame(raws, "reply_id long, raw string")).collect()}
    assert got == {1: ("hello", None, None, None), 2: ("m", "x", '{"a":1}', "5"), 3: ("[1]", None, None, None), 4: ("", None, None, None)}
    content = '{"parts":[{"text":"hi "},{"functionCall":{"name":"place_order","args":{"order":{}}}},{"text":"there"}]}'
    got = extract_tool_calls(spark.createDataFrame([(1, content)], "content_id long, content string")).first()
    assert (got.text, got["name"], got.args) == ("hi there", "place_order", '{"order":{}}')


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, "2024-05-06 07:08:09"), (" ", "2024-05-06 07:08:09"), ("0", "1970-01-01 00:00:00"), ("1.5e9", "2017-07-14 02:40:00"), ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+01:00", "2024-01-02 02:04:05"), ("20240102 03:04:05", "2024-01-02 03:04:05"), ("20240102-03:04:05", "2024-01-02 03:04:05"), ("soon", None), ("1e300", None), ("NaN", None)],
)
def test_ends_of_history(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(parse_end(F.col("t"), F.lit("2024-05-06 07:08:09").cast("timestamp")).cast("string"))
    assert df.first()[0] == want


@pytest.mark.parametrize(("text", "want"), [("30 D", "2024-03-01"), (" 1 w", "2024-03-24"), ("86400 S", "2024-03-30"), ("1M", "2024-02-29"), ("1 Y", "2023-03-31"), ("5 X", None), ("D", None), ("", None), (None, None), ("-1 D", None)])
def test_durations(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select((F.lit("2024-03-31 00:00:00").cast("timestamp") - parse_duration(F.col("t"))).cast("date").cast("string"))
    assert df.first()[0] == want


def test_bar_store_reads_only_its_folders(spark, tmp_path):
    bars = spark.range(0, 240).selectExpr("concat('S', id % 5) AS symbol", "timestamp_seconds(id * 7200) AS ts", "CAST(id AS DOUBLE) AS close")
    write_bar_store(bars, str(tmp_path / "store"), 8)
    got = read_bar_store(spark, str(tmp_path / "store"), "1970-01-10T00:00:00Z", "2 D", ["S1", "S3"], buckets=8)
    want = bars.filter("symbol IN ('S1', 'S3') AND ts > timestamp'1970-01-08 00:00:00' AND ts <= timestamp'1970-01-10 00:00:00'")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == bars.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("\n") if "FileScan" in x][0]
    assert "day#" in scan.split("PartitionFilters")[1] and "symbol_bucket#" in scan.split("PartitionFilters")[1]
    again = read_bar_store(spark, str(tmp_path / "store"), "1970-01-10T00:00:00Z", "2 D", ["S1", "S3"], buckets=8)
    for f in (tmp_path / "store").rglob("*.parquet"):  # files outside of the range are not opened
        if not any(f"day=1970-01-{d:02d}" in str(f) for d in (8, 9, 10)):
            f.write_bytes(b"broken")
            f.with_name(f".{f.name}.crc").unlink()
    assert len(again.collect()) == want.count()
    with pytest.raises(ValueError, match="no history range"):
        read_bar_store(spark, str(tmp_path / "store"), "soon", "2 D")


def mean_crossing():
    """A strategy that buys at closes above the mean of the five before; made here, so that it goes to tasks by value."""

    def decide(bars):
        import pandas as pd

        hit = bars[bars["close"] > bars["close"].rolling(5).mean().shift(1)]
        return pd.DataFrame({"symbol": hit["symbol"], "order_key": hit["bar_seq"], "submit_seq": hit["bar_seq"] + 1, "side": "BUY", "quantity": 1.0, "order_type": "MKT", "limit_price": None, "stop_price": None})

    return decide


@pytest.mark.parametrize("chunk", [1, 3, 7, 50, 1000])
def test_chunked_strategies_equal_whole_ones(spark, chunk):
    rng = random.Random(6)
    rows = [(s, k, 0.0, 0.0, 0.0, round(rng.uniform(90, 110), 2)) for s in "AB" for k in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, bar_seq long, open double, high double, low double, close double").repartition(5)
    key = lambda df: sorted((r.symbol, r.order_key, r.submit_seq) for r in df.collect())
    whole = key(pandas_signal(mean_crossing())(bars))
    assert whole and key(pandas_signal(mean_crossing(), chunk, 5)(bars)) == whole


def test_runs_as_a_table(spark):
    runs = spark.createDataFrame([("a", 1000.0, 0.0, 0.0), ("b", 0.0, 10.0, 2.0), ("c", None, -5.0, None)], "run_id string, initial_cash double, slippage_bps double, commission double")
    signal = lambda bars: bars.filter("bar_seq = 1").selectExpr("symbol", "bar_seq AS order_key", "bar_seq AS submit_seq", "'BUY' AS side", "2.0D AS quantity", "'MKT' AS order_type", "CAST(NULL AS DOUBLE) AS limit_price", "CAST(NULL AS DOUBLE) AS stop_price")
    got = {r.run_id: (r.start_equity, round(r.end_equity, 6), round(r.return_pct, 6)) for r in run_backtests(bars_of(spark), signal, runs).collect()}
    assert got == {"a": (1000.0, 1014.0, 1.4), "b": (0.0, round(14 - 204 * 0.001 - 2, 6), 0.0), "c": (100000.0, 100014.0, 0.014)}
    assert {r.run_id: r.end_equity for r in run_backtests(bars_of(spark), signal, [("x", 0.0, 1.0)], 500.0).collect()} == {"x": 513.0}
