"""Queries on bars, quotes and fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quantspark.functions import orders as order_rules
from quantspark.functions.quotes import apply_slippage, quotes_from_bars, usable_price, validate_quotes
from quantspark.functions.text import clean_double, parse_epoch
from quantspark.operators import asof, fills, ledger
from quantspark.operators.validate import validate_bars, validation_summary
from quantspark.plans import domain as d
from quantspark.plans.backtest import every_n_signal, run_backtests
from quantspark.sources import bars as src
from quantspark.sources.shared import written

BAR_COLS = ("symbol", "ts", "open", "high", "low", "close", "volume")

#: Text fields as files and vendors have them, with blanks, words and bad numbers among them.
TIME_TEXT = "CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN '2025-01-02T03:04:05Z' WHEN 2 THEN '2025-01-02 03:04:05' WHEN 3 THEN '' ELSE 'soon' END"
NUMBER_TEXT = "CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE '1.5' END"

#: Bars with every fault that the rules know, by event_id.
FAULTY = {
    "ts_epoch_s": "CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 40 = 0 THEN CAST(event_id - 100 AS DOUBLE) WHEN event_id % 30 = 0 THEN CAST(event_id - 5 AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END",
    "open": "CASE WHEN event_id % 25 = 0 THEN 50.0 WHEN event_id % 60 = 3 THEN NULL ELSE 10.0 END",
    "high": "CASE WHEN event_id % 35 = 0 THEN 5.0 WHEN event_id % 65 = 2 THEN CAST('NaN' AS DOUBLE) ELSE 12.0 END",
    "low": "CASE WHEN event_id % 45 = 0 THEN -1.0 WHEN event_id % 75 = 4 THEN CAST('NaN' AS DOUBLE) ELSE 8.0 END",
    "close": "CASE WHEN event_id % 55 = 0 THEN 13.0 WHEN event_id % 70 = 1 THEN 0.0 WHEN event_id % 85 = 6 THEN CAST('NaN' AS DOUBLE) ELSE 11.0 END",
}
#: Quotes around a bar's close, some crossed, negative or empty.
QUOTE = {
    "bid": "CASE bar_seq % 7 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE close - 0.5 END",
    "ask": "CASE bar_seq % 7 WHEN 0 THEN NULL WHEN 2 THEN close - 1.0 ELSE close + 0.5 END",
    "last": "CASE bar_seq % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE close END",
    "close": "CASE bar_seq % 11 WHEN 3 THEN -2.0 WHEN 0 THEN NULL ELSE close END",
}
V_FAULTY = f"v_faulty AS (SELECT upper(event_type) AS symbol, event_id AS bar_index, {d.sql_exprs(FAULTY)} FROM events)"
V_QUOTES = f"v_quotes AS (SELECT symbol, ts, bar_seq, volume, {d.sql_exprs(QUOTE)} FROM v_bars)"


def _faulty(spark, sf):
    return d.table(spark, sf, "events").selectExpr("upper(event_type) AS symbol", "event_id AS bar_index", *d.spark_exprs(FAULTY))


def _quotes(spark, sf):
    return d.bars(spark, sf).selectExpr("symbol", "ts", "bar_seq", "volume", *d.spark_exprs(QUOTE))


def _fills(spark, sf, **costs):
    return fills.match_fills(d.intents(spark, sf), d.bars(spark, sf), **costs)


def _fills_once(spark, sf):
    """Fills as a table, for queries that read them more than once."""
    return written(_fills(spark, sf), "fills")


def a2_parse_epoch(spark, sf):
    return d.table(spark, sf, "events").selectExpr("event_id", f"{TIME_TEXT} AS text").select("event_id", parse_epoch(F.col("text")).alias("epoch_s"))


A2 = f"""SELECT event_id, coalesce(try_cast(nullif(trim(t), '') AS DOUBLE), CASE WHEN t LIKE '2025%' THEN 1735787045.0 END) AS epoch_s
FROM (SELECT event_id, {TIME_TEXT} AS t FROM events)"""


def a5_merge_backfill(spark, sf):
    """Three overlapping pages of bars; later pages hold other closes."""
    bars = d.bars(spark, sf).select(*BAR_COLS, F.col("bar_seq").alias("ingest_seq"))
    page = lambda n, low, high: bars.filter((F.col("ingest_seq") % 10).between(low, high)).withColumns({"page_no": F.lit(n), "close": F.col("close") + n})
    return src.merge_backfill(page(1, 6, 9).unionByName(page(2, 3, 7)).unionByName(page(3, 0, 4))).drop("ingest_seq")


A5 = f"""{d.MARKET}, pages AS (SELECT *, unnest([1, 2, 3]) AS page_no FROM v_bars)
SELECT symbol, ts, open, high, low, close + page_no AS close, volume, page_no FROM pages
WHERE CASE page_no WHEN 1 THEN bar_seq % 10 BETWEEN 6 AND 9 WHEN 2 THEN bar_seq % 10 BETWEEN 3 AND 7 ELSE bar_seq % 10 BETWEEN 0 AND 4 END
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY page_no) = 1"""


def a7_slice_history(spark, sf):
    return src.slice_built_bars(d.ticks(spark, sf), "2024-01-20T00:00:00Z", "7 D").select(*BAR_COLS)


#: Ends and durations of history requests as vendors take them, and the ranges that they mean; now is 2024-01-25 12:00.
REQUESTS = [
    ("blank", " ", "2 D", "2024-01-23 12:00:00", "2024-01-25 12:00:00"), ("none", None, "3600 S", "2024-01-25 11:00:00", "2024-01-25 12:00:00"), ("epoch", "1705708800", "1 W", "2024-01-13 00:00:00", "2024-01-20 00:00:00"),
    ("iso", "2024-01-10T06:30:00Z", "36000 S", "2024-01-09 20:30:00", "2024-01-10 06:30:00"), ("offset", "2024-01-10T06:30:00+02:00", "1 d", "2024-01-09 04:30:00", "2024-01-10 04:30:00"), ("vendor", "20240128 00:00:00", " 1 M", "2023-12-28 00:00:00", "2024-01-28 00:00:00"),
]
NOW = "2024-01-25 12:00:00"


def a7_history_requests(spark, sf):
    """Bars of each request, built from its ticks."""
    parts = [src.slice_built_bars(d.ticks(spark, sf), end, duration, now=NOW).withColumn("request", F.lit(name)) for name, end, duration, _, _ in REQUESTS]
    return reduce(lambda a, b: a.unionByName(b), parts)


A7_REQUESTS = " UNION ALL ".join(f"SELECT {', '.join(BAR_COLS)}, '{name}' AS request FROM ({d.MARKET} SELECT * FROM v_bars) WHERE ts > TIMESTAMP '{first}' AND ts <= TIMESTAMP '{last}'" for name, _, _, first, last in REQUESTS)


def a8_filter_session(spark, sf):
    return src.filter_session(d.bars(spark, sf), "09:30", "16:00").select(*BAR_COLS)


def a9_normalize_bars(spark, sf):
    raw = d.table(spark, sf, "events").selectExpr("event_id", f"{TIME_TEXT} AS date", f"{NUMBER_TEXT} AS open", "'7' AS high", "CAST(NULL AS STRING) AS low", "'7.5' AS close", f"{NUMBER_TEXT} AS volume")
    return src.normalize_bars(raw).drop("date")


A9 = f"""SELECT event_id, coalesce(CASE WHEN NOT isnan(o) THEN o END, 0.0::DOUBLE) AS open, 7.0::DOUBLE AS high, 0.0::DOUBLE AS low, 7.5::DOUBLE AS close, CASE WHEN NOT isnan(o) THEN o END AS volume,
  coalesce(try_cast(nullif(t, '') AS DOUBLE), CASE WHEN t LIKE '2025%' THEN 1735787045.0 END) AS ts_epoch_s
FROM (SELECT event_id, {TIME_TEXT} AS t, try_cast(nullif({NUMBER_TEXT}, '') AS DOUBLE) AS o FROM events)"""


def b7_usable_price(spark, sf):
    return _quotes(spark, sf).select("symbol", "ts", usable_price(*(F.col(c) for c in ("last", "bid", "ask", "close"))).alias("px"))


B7 = f"""{d.MARKET}, {V_QUOTES} SELECT symbol, ts, CASE WHEN last > 0 THEN last WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 WHEN close > 0 THEN close END AS px FROM v_quotes"""


def b8_validate_quotes(spark, sf):
    return validate_quotes(_quotes(spark, sf)).select("symbol", "ts", "error")


B8 = f"""{d.MARKET}, {V_QUOTES} SELECT symbol, ts, CASE WHEN bid < 0 THEN 'Invalid bid in snapshot' WHEN ask < 0 THEN 'Invalid ask in snapshot'
  WHEN bid > ask THEN 'Invalid snapshot (bid > ask)' WHEN last < 0 OR close < 0 THEN 'Invalid price in snapshot' END AS error FROM v_quotes"""


def b9_clean_double(spark, sf):
    return d.table(spark, sf, "events").selectExpr("event_id", f"{NUMBER_TEXT} AS text").select("event_id", clean_double(F.col("text")).alias("value"))


B9 = f"SELECT event_id, CASE WHEN NOT isnan(v) THEN v END AS value FROM (SELECT event_id, try_cast({NUMBER_TEXT} AS DOUBLE) AS v FROM events)"


def b10_slippage(spark, sf):
    bps = F.when(F.col("order_key") % 3 == 0, 0.0).otherwise(5.0)
    return d.intents(spark, sf).select("order_key", apply_slippage(F.col("px"), F.col("side"), bps).alias("price"))


B10 = f"""{d.ORDERED} SELECT order_key, CASE WHEN order_key % 3 = 0 THEN px WHEN side = 'BUY' THEN px * (1 + 5.0::DOUBLE / 10000) ELSE px * (1 - 5.0::DOUBLE / 10000) END AS price FROM v_intents"""


def b11_quotes_from_bars(spark, sf):
    return quotes_from_bars(d.bars(spark, sf), 0.25)


B11 = f"{d.MARKET} SELECT symbol, ts, close - 0.125 AS bid, close + 0.125 AS ask, close AS last, close, volume FROM v_bars"


def b16_far_limit(spark, sf):
    return d.intents(spark, sf).select("order_key", order_rules.far_limit_price(F.col("side"), F.when(F.col("order_key") % 40 != 0, F.col("px")), F.col("px") / 4).alias("limit_price"))


B16 = f"""{d.ORDERED} SELECT order_key, CASE WHEN side = 'BUY' THEN greatest(0.01, 0.5 * p) ELSE p * 1.5 END AS limit_price
FROM (SELECT order_key, side, CASE WHEN order_key % 40 <> 0 THEN px ELSE px / 4 END AS p FROM v_intents)"""


def b17_align_ticks(spark, sf):
    return fills.align_ticks(d.bars(spark, sf)).select("symbol", "tick", "visible_seq", "fillable_seq")


def c1_asof_quotes(spark, sf):
    """Intents against quotes no older than a day; some intents and quotes have no symbol, and find nothing."""
    quotes = _quotes(spark, sf).drop("bar_seq")
    quotes = quotes.unionByName(quotes.filter("hour(ts) % 3 = 0").withColumn("symbol", F.lit(None).cast("string")))
    intents = d.intents(spark, sf).select("order_key", F.expr("CASE WHEN order_key % 97 <> 0 THEN symbol END").alias("symbol"), "ts")
    return asof.asof_quotes(intents, quotes, 86400.0).select("order_key", "bid", "ask", "last", "close", F.col("asof_ts").alias("quote_ts"))


C1 = f"""{d.ORDERED}, {V_QUOTES}
SELECT order_key, CASE WHEN f THEN bid END AS bid, CASE WHEN f THEN ask END AS ask, CASE WHEN f THEN last END AS last, CASE WHEN f THEN close END AS close, CASE WHEN f THEN q END AS quote_ts
FROM (SELECT i.order_key, q.bid, q.ask, q.last, q.close, q.ts AS q, coalesce(epoch(i.ts) - epoch(q.ts) <= 86400, false) AS f
      FROM (SELECT order_key, ts, CASE WHEN order_key % 97 <> 0 THEN symbol END AS symbol FROM v_intents) i ASOF LEFT JOIN v_quotes q ON i.symbol = q.symbol AND i.ts >= q.ts)"""


def c2_history_features(spark, sf):
    return fills.history_features(d.bars(spark, sf)).withColumn("mean_close", F.round("mean_close", 6))


C2 = f"""{d.MARKET} SELECT symbol, bar_seq, count(*) OVER p AS n_seen, max(high) OVER p AS high_seen, min(low) OVER p AS low_seen,
  round(avg(close) OVER (PARTITION BY symbol ORDER BY bar_seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS mean_close
FROM v_bars WINDOW p AS (PARTITION BY symbol ORDER BY bar_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def c3_match_fills(spark, sf):
    return _fills(spark, sf).select("order_key", "symbol", "bar_seq", "fill_ts", "price")


def c6_fill_missing_quotes(spark, sf):
    quotes = _quotes(spark, sf).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 MINUTES"))
    empty = F.col("bar_seq") % 35 == 0
    quotes = quotes.withColumns({c: F.when(~empty, F.col(c)) for c in ("bid", "ask", "last", "close")})
    return asof.fill_missing_quotes(quotes, d.bars(spark, sf)).select("symbol", "ts", "bid", "ask", "last", "close", "volume")


C6 = f"""{d.MARKET}, {V_QUOTES} SELECT q.symbol, q.ts + INTERVAL 30 MINUTES AS ts, CASE WHEN NOT e THEN q.bid END AS bid, CASE WHEN NOT e THEN q.ask END AS ask,
  CASE WHEN e OR coalesce(q.bid, q.ask, q.last, q.close) IS NULL THEN b.close ELSE q.last END AS last,
  CASE WHEN e OR coalesce(q.bid, q.ask, q.last, q.close) IS NULL THEN b.close ELSE q.close END AS close, q.volume
FROM (SELECT *, bar_seq % 35 = 0 AS e FROM v_quotes) q JOIN v_bars b USING (symbol, bar_seq)"""


def d2_ledger_totals(spark, sf):
    out = ledger.ledger_totals(_fills(spark, sf, slippage_bps=5.0, commission=1.0))
    return out.withColumn("cash", F.round("cash", 4))


SLIPPED = "price * CASE WHEN side = 'BUY' THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END"
D2 = f"""{d.FILLED} SELECT run_id, symbol, count(*) AS n_fills, round(100000 - sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END * {SLIPPED}) - count(*), 4) AS cash,
  sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS position FROM v_fills GROUP BY 1, 2"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


def d3_backtest_summary(spark, sf):
    totals = ledger.ledger_totals(_fills(spark, sf, slippage_bps=5.0, commission=1.0))
    return _rounded(ledger.backtest_summary(totals, d.bars(spark, sf)), "end_equity", "return_pct")


D3 = f"""{d.FILLED}, t AS (SELECT run_id, symbol, 100000 - sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END * {SLIPPED}) - count(*) AS cash,
  sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS position FROM v_fills GROUP BY 1, 2),
l AS (SELECT symbol, arg_max(close, bar_seq) AS last_close FROM v_bars GROUP BY 1)
SELECT run_id, symbol, 100000.0::DOUBLE AS start_equity, round(cash + position * last_close, 4) AS end_equity, round((cash + position * last_close - 100000) / 100000 * 100, 4) AS return_pct FROM t JOIN l USING (symbol)"""


def d4_validation_summary(spark, sf):
    return validation_summary(validate_bars(_faulty(spark, sf)))


def e1_validate_bars(spark, sf):
    """Faulty bars of all symbols, with one symbol that has none."""
    expected = d.table(spark, sf, "events").select(F.upper("event_type").alias("symbol")).union(d.table(spark, sf, "region").select("r_name")).distinct()
    return validate_bars(_faulty(spark, sf), expected).select("symbol", "bar_index", "level", "code")


V_ISSUES = f"""{V_FAULTY}, o AS (SELECT *, last_value(ts_epoch_s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY symbol, ts_epoch_s ORDER BY bar_index) > 1 AS again FROM v_faulty),
r AS (SELECT symbol, bar_index, unnest([
  CASE WHEN ts_epoch_s IS NULL THEN 'error missing_timestamp' END, CASE WHEN ts_epoch_s < before THEN 'error not_sorted' END,
  CASE WHEN ts_epoch_s IS NOT NULL AND open IS NULL THEN 'error missing_open' END, CASE WHEN ts_epoch_s IS NOT NULL AND open <= 0 THEN 'error non_positive_open' END,
  CASE WHEN ts_epoch_s IS NOT NULL AND high <= 0 THEN 'error non_positive_high' END, CASE WHEN ts_epoch_s IS NOT NULL AND low <= 0 THEN 'error non_positive_low' END,
  CASE WHEN ts_epoch_s IS NOT NULL AND close <= 0 THEN 'error non_positive_close' END, CASE WHEN ts_epoch_s IS NOT NULL AND low > high AND NOT isnan(low) THEN 'error low_above_high' END,
  CASE WHEN ts_epoch_s IS NOT NULL AND (open < low OR open > high OR (open IS NOT NULL AND (isnan(low) OR isnan(high)))) THEN 'warn open_outside' END, CASE WHEN ts_epoch_s IS NOT NULL AND (close < low OR close > high OR isnan(close) OR isnan(low) OR isnan(high)) THEN 'warn close_outside' END,
  CASE WHEN again THEN 'warn duplicate_timestamp' END]) AS issue FROM o),
v_issues AS (SELECT symbol, bar_index, split_part(issue, ' ', 1) AS level, split_part(issue, ' ', 2) AS code FROM r WHERE issue IS NOT NULL)"""
E1 = f"WITH {V_ISSUES} SELECT * FROM v_issues UNION ALL SELECT r_name, -1, 'error', 'no_bars' FROM region WHERE r_name NOT IN (SELECT symbol FROM v_faulty)"
D4 = f"""WITH {V_ISSUES} SELECT symbol, count(*) FILTER (level = 'error') AS n_errors, count(*) FILTER (level = 'warn') AS n_warnings, bool_or(level = 'error') AS failed FROM v_issues GROUP BY symbol"""


def e3_running_ledger(spark, sf):
    return _rounded(ledger.running_ledger(_fills_once(spark, sf)).select("order_key", "cash", "position"), "cash")


E3 = f"""{d.FILLED} SELECT order_key, round(100000 - sum(q * price) OVER w, 4) AS cash, sum(q) OVER w AS position
FROM (SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q FROM v_fills) WINDOW w AS (PARTITION BY run_id, symbol ORDER BY bar_seq, order_key ROWS UNBOUNDED PRECEDING)"""


def e4_average_cost(spark, sf):
    return _rounded(ledger.average_cost(_fills_once(spark, sf)), "avg_cost")


E4 = """WITH RECURSIVE """ + d.FILLED.removeprefix("WITH ") + """,
f AS (SELECT run_id, symbol, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS dq, price AS px, row_number() OVER (PARTITION BY run_id, symbol ORDER BY bar_seq, order_key) AS k FROM v_fills),
s(run_id, symbol, k, qty, cost) AS (
  SELECT DISTINCT run_id, symbol, 0::BIGINT, 0.0::DOUBLE, NULL::DOUBLE FROM f UNION ALL
  SELECT s.run_id, s.symbol, f.k, s.qty + f.dq, CASE WHEN s.qty + f.dq = 0 THEN NULL WHEN s.qty = 0 OR sign(s.qty) = sign(f.dq)
    THEN (abs(s.qty) * coalesce(s.cost, 0) + abs(f.dq) * f.px) / abs(s.qty + f.dq) ELSE s.cost END
  FROM s JOIN f ON f.run_id = s.run_id AND f.symbol = s.symbol AND f.k = s.k + 1)
SELECT run_id, symbol, arg_max(qty, k) AS position, round(arg_max_null(cost, k), 4) AS avg_cost FROM s GROUP BY 1, 2"""


def e5_equity_curve(spark, sf):
    return _rounded(ledger.equity_curve(_fills_once(spark, sf), d.bars(spark, sf)), "cash", "net_liquidation", "gross_position_value", "available_funds")


E5 = f"""{d.FILLED}, q AS (SELECT run_id, symbol, bar_seq, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS dq, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END * price) AS spent FROM v_fills GROUP BY ALL),
g AS (SELECT r.run_id, r.symbol, b.bar_seq, b.ts, b.close, 100000 - coalesce(sum(spent) OVER w, 0) AS cash, coalesce(sum(dq) OVER w, 0) AS position
  FROM (SELECT DISTINCT run_id, symbol FROM v_fills) r JOIN v_bars b USING (symbol) LEFT JOIN q ON q.run_id = r.run_id AND q.symbol = r.symbol AND q.bar_seq = b.bar_seq
  WINDOW w AS (PARTITION BY r.run_id, r.symbol ORDER BY b.bar_seq ROWS UNBOUNDED PRECEDING))
SELECT run_id, symbol, bar_seq, ts, round(cash, 4) AS cash, position, round(cash + position * close, 4) AS net_liquidation, round(abs(position * close), 4) AS gross_position_value,
  round(cash + position * close, 4) AS available_funds, 0.0::DOUBLE AS maint_margin_req FROM g"""

RUNS = [("base", 0.0, 0.0), ("slip", 5.0, 0.0), ("cost", 10.0, 1.0)]


def e13_backtests_of_table(spark, sf):
    """A run for each supplier with cash, slippage and commission of its own, in all symbols; the strategy buys on every fifth tick and sells on every seventh."""
    runs = d.table(spark, sf, "supplier").selectExpr("concat('s', s_suppkey) AS run_id", *d.spark_exprs(RUN))

    def both(bars):
        sells = every_n_signal(bars, 7, 2.0).withColumns({"side": F.lit("SELL"), "order_key": F.col("order_key") + 1000000000})
        return every_n_signal(bars, 5).unionByName(sells)

    # amounts have six decimals at most, so that many lie half-way between two roundings; a little more decides them alike
    out = run_backtests(d.bars(spark, sf), both, runs)
    return _rounded(out.withColumns({c: F.col(c) + 1e-7 for c in ("end_equity", "return_pct")}), "end_equity", "return_pct")


#: Costs of a run, by supplier; one has no cash at all.
RUN = {"initial_cash": "CAST(s_suppkey % 10 * 50000 AS DOUBLE)", "slippage_bps": "CAST(s_suppkey % 4 * 5 - 5 AS DOUBLE)", "commission": "CAST(s_suppkey % 3 AS DOUBLE)"}
E13_TABLE = f"""{d.MARKET}, r AS (SELECT concat('s', s_suppkey) AS run_id, {d.sql_exprs(RUN)} FROM supplier),
f AS (SELECT symbol, open, 1.0 AS q FROM v_bars WHERE bar_seq % 5 = 4 UNION ALL SELECT symbol, open, -2.0 FROM v_bars WHERE bar_seq % 7 = 6),
t AS (SELECT run_id, symbol, any_value(initial_cash) AS cash, sum(q * open * (1 + CASE WHEN slippage_bps <= 0 THEN 0 WHEN q > 0 THEN slippage_bps / 10000 ELSE -slippage_bps / 10000 END)) + count(*) * any_value(commission) AS spent, sum(q)::DOUBLE AS n FROM f, r GROUP BY ALL),
l AS (SELECT symbol, arg_max(close, bar_seq) AS c FROM v_bars GROUP BY 1)
SELECT run_id, symbol, cash AS start_equity, round(cash - spent + n * c + 1e-7, 4) AS end_equity, round(CASE WHEN cash <> 0 THEN (n * c - spent) / cash * 100 ELSE 0 END + 1e-7, 4) AS return_pct FROM t JOIN l USING (symbol)"""


def e13_backtests(spark, sf):
    """The return of buying at every twelfth tick, for each symbol and set of costs."""
    return _rounded(run_backtests(d.bars(spark, sf), every_n_signal, RUNS), "end_equity", "return_pct")


E13 = f"""{d.MARKET}, r AS (SELECT * FROM (VALUES ('base', 0.0::DOUBLE, 0), ('slip', 5.0, 0), ('cost', 10.0, 1)) t(run_id, bps, fee)),
t AS (SELECT run_id, symbol, sum(open * (1 + bps / 10000)) + count(*) * any_value(fee) AS spent, count(*) AS n FROM v_bars, r WHERE bar_seq % 12 = 11 GROUP BY ALL),
l AS (SELECT symbol, arg_max(close, bar_seq) AS c FROM v_bars GROUP BY 1)
SELECT run_id, symbol, 100000.0::DOUBLE AS start_equity, round(100000 - spent + n * c, 4) AS end_equity, round((n * c - spent) / 100000 * 100, 4) AS return_pct FROM t JOIN l USING (symbol)"""

BARS = ", ".join(BAR_COLS)
QUERIES = {
    "a2_parse_epoch": (a2_parse_epoch, A2),
    "a5_merge_backfill": (a5_merge_backfill, A5),
    "a6_build_bars": (lambda s, sf: d.bars(s, sf).select(*BAR_COLS), f"{d.MARKET} SELECT {BARS} FROM v_bars"),
    "a7_slice_history": (a7_slice_history, f"{d.MARKET} SELECT {BARS} FROM v_bars WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-13'"),
    "a7_history_requests": (a7_history_requests, A7_REQUESTS),
    "a8_filter_session": (a8_filter_session, f"{d.MARKET} SELECT {BARS} FROM v_bars WHERE strftime(ts, '%H:%M') >= '09:30' AND strftime(ts, '%H:%M') < '16:00'"),
    "a9_normalize_bars": (a9_normalize_bars, A9),
    "a10_preview_bars": (lambda s, sf: src.preview_bars(d.bars(s, sf)).select(*BAR_COLS, "n_bars"), f"{d.MARKET} SELECT {BARS}, count(*) OVER (PARTITION BY symbol) AS n_bars FROM v_bars QUALIFY bar_seq < 5"),
    "b7_usable_price": (b7_usable_price, B7),
    "b8_validate_quotes": (b8_validate_quotes, B8),
    "b9_clean_double": (b9_clean_double, B9),
    "b10_slippage": (b10_slippage, B10),
    "b11_quotes_from_bars": (b11_quotes_from_bars, B11),
    "b16_far_limit": (b16_far_limit, B16),
    "b17_align_ticks": (b17_align_ticks, f"{d.MARKET} SELECT symbol, bar_seq AS tick, greatest(bar_seq - 1, 0) AS visible_seq, bar_seq AS fillable_seq FROM v_bars"),
    "c1_asof_quotes": (c1_asof_quotes, C1),
    "c2_history_features": (c2_history_features, C2),
    "c3_match_fills": (c3_match_fills, f"{d.FILLED} SELECT order_key, symbol, bar_seq, fill_ts, price FROM v_fills"),
    "c6_fill_missing_quotes": (c6_fill_missing_quotes, C6),
    "d2_ledger_totals": (d2_ledger_totals, D2),
    "d3_backtest_summary": (d3_backtest_summary, D3),
    "d4_validation_summary": (d4_validation_summary, D4),
    "e1_validate_bars": (e1_validate_bars, E1),
    "e2_every_n_signal": (lambda s, sf: every_n_signal(d.bars(s, sf)).select("symbol", "submit_seq", "side", "quantity"), f"{d.MARKET} SELECT symbol, bar_seq AS submit_seq, 'BUY' AS side, 1.0::DOUBLE AS quantity FROM v_bars WHERE bar_seq % 12 = 11"),
    "e3_running_ledger": (e3_running_ledger, E3),
    "e4_average_cost": (e4_average_cost, E4),
    "e5_equity_curve": (e5_equity_curve, E5),
    "e12_sort_bars": (lambda s, sf: d.bars(s, sf).orderBy("symbol", "ts").select("symbol", "ts", "bar_seq"), f"{d.MARKET} SELECT symbol, ts, bar_seq FROM v_bars ORDER BY symbol, ts"),
    "e13_backtests": (e13_backtests, E13),
    "e13_backtests_of_table": (e13_backtests_of_table, E13_TABLE),
}
