"""Market data, orders and audit tables as views of the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.sources.bars import build_bars, number_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.upper("event_type").alias("symbol"), "ts", F.col("value").alias("px"), "user_id")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_bars(build_bars(ticks(spark, sf_dir)))


#: Expressions that both engines read alike; // is div in Spark.
INTENT = {
    "run_id": "concat('run', event_id % 3)",
    "account": "concat('a', user_id % 40)",
    "order_key": "event_id",
    "side": "CASE WHEN (event_id // 80) % 2 = 0 THEN 'BUY' ELSE 'SELL' END",
    "quantity": "CAST(1 + event_id % 7 AS DOUBLE)",
    "order_type": "CASE (event_id // 20) % 4 WHEN 0 THEN 'MKT' WHEN 1 THEN 'LMT' WHEN 2 THEN 'STP' ELSE 'STPLMT' END",
    "limit_price": "CASE WHEN event_id % 89 = 0 AND (event_id // 20) % 2 = 1 THEN CAST('NaN' AS DOUBLE) WHEN (event_id // 20) % 4 = 1 THEN px WHEN (event_id // 20) % 4 = 3 THEN px + CASE WHEN (event_id // 80) % 2 = 0 THEN 5 ELSE -5 END END",
    "stop_price": "CASE WHEN event_id % 101 = 0 AND (event_id // 20) % 4 IN (2, 3) THEN CAST('NaN' AS DOUBLE) WHEN (event_id // 20) % 4 IN (2, 3) THEN px END",
}


def spark_exprs(exprs: dict[str, str]) -> list[str]:
    return [f"{e.replace('//', 'div')} AS {name}" for name, e in exprs.items()]


def sql_exprs(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {name}" for name, e in exprs.items())


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick is an intent, eligible from the bar after its own hour."""
    own = ticks(spark, sf_dir).selectExpr("ts", "symbol", "px", "date_trunc('hour', ts) AS hour", *spark_exprs(INTENT))
    at = bars(spark, sf_dir).select("symbol", F.col("ts").alias("hour"), (F.col("bar_seq") + 1).cast("long").alias("submit_seq"))
    return own.join(at, ["symbol", "hour"]).drop("hour")


def status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('o', user_id) AS order_id", "concat('run', user_id % 3) AS run_id", "ts", f"{STATUS} AS status")


STATUS = "CASE event_type WHEN 'signup' THEN 'PreSubmitted' WHEN 'view' THEN 'Submitted' WHEN 'click' THEN 'Submitted' WHEN 'purchase' THEN 'Filled' ELSE 'Cancelled' END"
ORDER_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'Submitted' WHEN 'P' THEN 'PreSubmitted' ELSE 'Filled' END"


def audit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('o', o_custkey) AS order_id", "o_orderkey AS seq", f"{ORDER_STATUS} AS status", "o_totalprice AS price", "o_custkey AS custkey")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: plain, fenced, and not JSON."""
    rows = ticks(spark, sf_dir).selectExpr("event_id", "symbol", *spark_exprs({k: INTENT[k] for k in ("side", "quantity")}))
    return rows.selectExpr("event_id AS resp_id", f"{BODY} AS body").selectExpr("resp_id", f"{RAW} AS raw")


BODY = """concat('{"decisions":[{"action":"place","order":{"instrument":{"kind":"STK","symbol":"', lower(symbol), '"},"side":"', side, '","qty":', CAST(CAST(quantity AS BIGINT) AS STRING), ',"type":"MKT"}},{"action":"CANCEL","order_id":"', CAST(event_id AS STRING), '"}]}')"""
RAW = "CASE WHEN resp_id % 100 = 0 THEN 'not json' WHEN resp_id % 100 = 20 THEN concat('```json', chr(10), body, chr(10), '```') ELSE body END"

#: Snapshots of accounts, one for each event, some without values.
ACCOUNT = {
    "net_liquidation": "CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 53 = 0 THEN -1.0 ELSE CAST(100000 - event_id % 1500 AS DOUBLE) END",
    "gross_position_value": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 250 * 1000 AS DOUBLE) END",
    "maint_margin_req": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 60 * 1000 AS DOUBLE) END",
}


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("concat('a', user_id % 40) AS account", "ts", "event_id AS seq", *spark_exprs(ACCOUNT))
    return rows.withColumns({c: F.col(c).cast("double") for c in ACCOUNT})


V_ACCOUNTS = f"""v_accounts AS (SELECT concat('a', user_id % 40) AS account, ts, {sql_exprs(ACCOUNT)} FROM events
QUALIFY row_number() OVER (PARTITION BY user_id % 40, ts ORDER BY event_id DESC) = 1)"""
V_TICKS = "v_ticks AS (SELECT event_id, upper(event_type) AS symbol, ts, value AS px, user_id FROM events)"
V_BARS = """v_bars AS (SELECT symbol, bar_ts AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS bar_seq
FROM (SELECT symbol, date_trunc('hour', ts) AS bar_ts, first(px ORDER BY ts, event_id) AS open, max(px) AS high, min(px) AS low,
             last(px ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM v_ticks GROUP BY 1, 2))"""
V_INTENTS = f"""v_intents AS (SELECT t.*, b.bar_seq + 1 AS submit_seq FROM (SELECT ts, symbol, px, {sql_exprs(INTENT)} FROM v_ticks) t
JOIN v_bars b ON b.symbol = t.symbol AND b.ts = date_trunc('hour', t.ts))"""
V_STATUS = f"v_status AS (SELECT event_id AS id, concat('o', user_id) AS order_id, concat('run', user_id % 3) AS run_id, ts, {STATUS} AS status FROM events)"
V_ORDERS = f"v_orders AS (SELECT concat('o', o_custkey) AS order_id, o_orderkey AS seq, {ORDER_STATUS} AS status, o_totalprice AS price, o_custkey AS custkey FROM orders)"
V_FILLS = """v_touch AS (SELECT i.order_key, min(b.bar_seq) AS bar_seq FROM v_intents i JOIN v_bars b ON b.symbol = i.symbol AND b.bar_seq >= i.submit_seq
  AND (i.order_type <> 'MKT' OR b.bar_seq = i.submit_seq) AND NOT isnan(coalesce(i.limit_price, 0)) AND NOT isnan(coalesce(i.stop_price, 0))
  AND CASE i.order_type WHEN 'MKT' THEN true
      WHEN 'LMT' THEN CASE i.side WHEN 'BUY' THEN b.low <= i.limit_price ELSE b.high >= i.limit_price END
      WHEN 'STP' THEN CASE i.side WHEN 'BUY' THEN b.high >= i.stop_price ELSE b.low <= i.stop_price END
      ELSE CASE i.side WHEN 'BUY' THEN b.high >= i.stop_price AND b.low <= i.limit_price ELSE b.low <= i.stop_price AND b.high >= i.limit_price END END
  GROUP BY i.order_key),
v_fills AS (SELECT i.*, b.bar_seq, b.ts AS fill_ts, CASE i.order_type WHEN 'MKT' THEN b.open WHEN 'STP' THEN i.stop_price ELSE i.limit_price END AS price
  FROM v_touch t JOIN v_intents i USING (order_key) JOIN v_bars b ON b.symbol = i.symbol AND b.bar_seq = t.bar_seq)"""
MARKET = f"WITH {V_TICKS}, {V_BARS}"
ORDERED = f"{MARKET}, {V_INTENTS}"
FILLED = f"{ORDERED}, {V_FILLS}"
V_RAW = f"""v_raw AS (SELECT resp_id, {RAW} AS raw FROM (SELECT event_id AS resp_id, {BODY} AS body FROM
  (SELECT event_id, symbol, {sql_exprs({k: INTENT[k] for k in ("side", "quantity")})} FROM v_ticks)))"""
