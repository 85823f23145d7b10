"""Streaming queries over what is there now; they equal their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantspark.plans import domain as d
from quantspark.plans import market, trading
from quantspark.sources.audit import read_audit
from quantspark.sources.shared import shared_dir
from quantspark.streaming.bars import FEED, stream_bars, stream_build_bars, stream_evaluate, stream_trade, stream_validate_bars
from quantspark.streaming.run import fed, read_stream, run_available
from quantspark.streaming.states import stream_latest_quotes, stream_transitions


def _events(spark, sf):
    return read_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _fed(spark, sf, table, order):
    """The table as a stream of several micro-batches, in order."""
    return fed(d.table(spark, sf, table), order)


def s1_stream_transitions(spark, sf):
    feed = _fed(spark, sf, "events", "event_id").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr("event_id AS id", "concat('o', user_id) AS order_id", "ts", f"{d.STATUS} AS status")
    return run_available(stream_transitions(feed), "transitions").select("order_id", "id", "ts", "status")


def s1_transitions_in_run(spark, sf):
    """The same with an order's memory kept for each run."""
    feed = _fed(spark, sf, "events", "event_id").selectExpr("event_id AS id", "concat('o', user_id) AS order_id", "concat('run', event_id % 3) AS run_id", "CAST(ts AS TIMESTAMP) AS ts", f"{d.STATUS} AS status")
    return run_available(stream_transitions(feed, keys=("run_id", "order_id")), "transitions").select("run_id", "order_id", "id", "ts", "status")


S1_RUN = f"""SELECT run_id, order_id, id, ts, status FROM (SELECT event_id AS id, concat('o', user_id) AS order_id, concat('run', event_id % 3) AS run_id, ts, {d.STATUS} AS status FROM events)
QUALIFY lag(status) OVER (PARTITION BY run_id, order_id ORDER BY ts, id) IS DISTINCT FROM status"""


def s2_track_timeouts(spark, sf):
    """Orders that have had no event for a day while open, by the time of the events."""
    feed = fed(d.status_feed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    out = run_available(stream_transitions(feed, 86400.0, delay="10 minutes"), "timeouts")
    return out.filter("where_text is not null").select("order_id", "ts", "status", "where_text", "message")


S2 = f"""WITH {d.V_STATUS}, g AS (SELECT *, lead(ts) OVER (PARTITION BY order_id ORDER BY ts, id) AS next FROM v_status)
SELECT order_id, ts + INTERVAL 1 DAY AS ts, status, 'oms.track' AS where_text, 'timeout_seconds=86400.0' AS message FROM g
WHERE status NOT IN ({trading.TERMINAL}) AND coalesce(next, (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES) > ts + INTERVAL 1 DAY"""


def s3_quote_expiry(spark, sf):
    """Every third quote is six hours old when it is seen; it goes on if its symbol's last one was seen more than half an hour before."""
    rows = d.table(spark, sf, "events").selectExpr("upper(event_type) AS symbol", "CAST(ts AS TIMESTAMP) AS seen_at", "CAST(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 6 HOURS ELSE ts END AS TIMESTAMP) AS ts", "CAST(NULL AS DOUBLE) AS bid", "CAST(NULL AS DOUBLE) AS ask", "value AS last", "CAST(NULL AS DOUBLE) AS close")
    feed = fed(rows, "seen_at")
    return run_available(stream_latest_quotes(feed, 1800.0, "1 minute"), "expiry").select("symbol", "seen_at", "ts", "last")


S3_EXPIRY = """WITH RECURSIVE q AS (SELECT upper(event_type) AS symbol, ts AS seen_at, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 6 HOURS ELSE ts END AS ts, value AS last, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
s(symbol, k, newest, seen, goes, last) AS (SELECT symbol, k, ts, seen_at, true, last FROM q WHERE k = 1 UNION ALL
  SELECT q.symbol, q.k, CASE WHEN q.seen_at - s.seen > INTERVAL 30 MINUTES OR q.ts > s.newest THEN q.ts ELSE s.newest END, CASE WHEN q.seen_at - s.seen > INTERVAL 30 MINUTES OR q.ts > s.newest THEN q.seen_at ELSE s.seen END,
    q.seen_at - s.seen > INTERVAL 30 MINUTES OR q.ts > s.newest, q.last FROM s JOIN q ON q.symbol = s.symbol AND q.k = s.k + 1)
SELECT symbol, seen AS seen_at, newest AS ts, last FROM s WHERE goes"""


def s3_stream_latest_quotes(spark, sf):
    quotes = _events(spark, sf).selectExpr("upper(event_type) AS symbol", "ts", "value - 0.5 AS bid", "value + 0.5 AS ask", "value AS last", "CAST(NULL AS DOUBLE) AS close")
    base = f"{shared_dir(spark)}/quotes-{uuid.uuid4().hex}"
    out = stream_latest_quotes(quotes, None)
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{base}/out/*")
    return found.groupBy("symbol").agg(F.max_by(F.struct("ts", "bid", "ask", "last"), "ts").alias("q")).select("symbol", "q.*")


def s4_stream_bars(spark, sf):
    """Faulty bars, each there twice."""
    rows = _events(spark, sf).selectExpr("upper(event_type) AS symbol", "ts", *d.spark_exprs({k: market.FAULTY[k] for k in ("open", "high", "low", "close")}), "explode(array(1, 2)) AS copy").drop("copy")
    return run_available(stream_bars(rows), "bars").select("symbol", "ts", "issue")


S4 = f"""SELECT upper(event_type) AS symbol, ts, CASE WHEN open IS NULL THEN 'missing price' WHEN least(open, high, low, close) <= 0 THEN 'non-positive price' WHEN low > high AND NOT isnan(low) THEN 'low > high'
  WHEN open < low OR open > high OR isnan(low) OR isnan(high) THEN 'open outside [low,high]' WHEN close < low OR close > high OR isnan(close) THEN 'close outside [low,high]' END AS issue
FROM (SELECT event_type, ts, {d.sql_exprs(market.FAULTY)} FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) = 1)"""


def s4_stream_order(spark, sf):
    """Faulty bars in three batches, with all issues, those of their order among them."""
    rows = d.table(spark, sf, "events").selectExpr("upper(event_type) AS symbol", "event_id AS bar_index", *d.spark_exprs(market.FAULTY))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in market.FAULTY})
    out = run_available(stream_validate_bars(fed(rows, "bar_index"), 3600.0), "issues")
    return out.select("symbol", "bar_index", "level", "code")


def s5_stream_build_bars(spark, sf):
    ticks = _events(spark, sf).selectExpr("event_id", "upper(event_type) AS symbol", "ts", "value AS px")
    return run_available(stream_build_bars(ticks), "built-bars")


def s6_stream_evaluate(spark, sf):
    base = f"{shared_dir(spark)}/evaluate-{uuid.uuid4().hex}"
    intents = _fed(spark, sf, "orders", "o_orderkey").selectExpr(*d.spark_exprs(trading.RISK))
    enrich = lambda batch: batch.withColumns({c: F.col(c).cast("double") for c in ("quantity", "net_liquidation")})
    stream_evaluate(intents, enrich, f"{base}/audit", f"{base}/checkpoint").awaitTermination()
    return read_audit(spark, "decisions", f"{base}/audit").select("run_id", "seq", "accepted", "reason")


def _feed(spark, sf, parts):
    """Rows of a feed in three batches by time; columns that a kind of row does not fill are null."""
    rows = None
    for part in parts:
        part = part.withColumn("ts", F.col("ts").cast("timestamp"))
        part = part.select(*[(F.col(f.name) if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(FEED)])
        rows = part if rows is None else rows.unionByName(part)
    return fed(rows, "ts")


def _decided(spark, feed, **options):
    base = f"{shared_dir(spark)}/trade-{uuid.uuid4().hex}"
    stream_trade(feed, f"{base}/audit", f"{base}/checkpoint", **options).awaitTermination()
    return read_audit(spark, "decisions", f"{base}/audit").select("run_id", "seq", "strategy", "accepted", "reason")


def _what(rows, what):
    return rows.withColumn("what", F.lit(what))


def s6_stream_feeds(spark, sf):
    """Intents, quotes, accounts and positions as one feed in three batches; decisions equal those of e6_risk_from_feeds."""
    intents = d.intents(spark, sf).select("run_id", F.col("order_key").alias("seq"), F.lit("STK").alias("kind"), "symbol", "account", "ts", "side", "quantity")
    quotes = d.bars(spark, sf).selectExpr("symbol", "ts", "bar_seq AS seq", "volume", *d.spark_exprs(market.QUOTE))
    held = d.table(spark, sf, "nation").selectExpr(*d.spark_exprs(trading.HELD), "timestamp'2000-01-01 00:00:00' AS ts", "n_nationkey AS seq")
    feed = _feed(spark, sf, [_what(intents, "intent"), _what(quotes, "quote"), _what(d.accounts(spark, sf), "account"), _what(held, "position")])
    return _decided(spark, feed, ttl_s=86400.0)


def s6_stream_signals(spark, sf):
    """A quote at each bar's close, every twelfth of which is an intent to buy; account values come a little before."""
    quotes = d.bars(spark, sf).selectExpr("symbol", "ts", "bar_seq AS seq", "symbol AS run_id", "'STK' AS kind", "symbol AS account", "close AS last")
    accounts = quotes.selectExpr("account", "ts - INTERVAL 1 MINUTE AS ts", "seq", "100000.0 - seq * 3 AS net_liquidation", "last * 1000 AS gross_position_value", "0.0 AS maint_margin_req")
    return _decided(spark, _feed(spark, sf, [_what(quotes, "quote"), _what(accounts, "account")]), every_n=12)


S6_SIGNALS = f"""{d.MARKET}, h AS (SELECT symbol, bar_seq, close, 100000.0 - bar_seq * 3 AS net, 100000.0 - 11 * 3 AS first FROM v_bars WHERE bar_seq % 12 = 11),
r AS (SELECT symbol, bar_seq, CASE WHEN NOT coalesce(close > 0, false) THEN 'no usable price' WHEN close * 1000 + close > 250000 THEN 'max_notional_exposure exceeded' WHEN close * 1000 / net > 2 THEN 'max_leverage exceeded'
  WHEN first - net > 1000 THEN 'max_daily_loss exceeded (circuit breaker)' END AS reason FROM h)
SELECT symbol AS run_id, bar_seq AS seq, 'every_n' AS strategy, CAST(reason IS NULL AS INTEGER) AS accepted, reason FROM r"""

QUERIES = {
    "s2_track_timeouts": (s2_track_timeouts, S2),
    "s3_quote_expiry": (s3_quote_expiry, S3_EXPIRY),
    "s4_stream_order": (s4_stream_order, f"WITH {market.V_ISSUES} SELECT * FROM v_issues"),
    "s6_stream_feeds": (s6_stream_feeds, f"SELECT run_id, seq, 'feed' AS strategy, CAST(reason IS NULL AS INTEGER) AS accepted, reason FROM ({trading.E6_FEEDS})"),
    "s6_stream_signals": (s6_stream_signals, S6_SIGNALS),
    "s1_stream_transitions": (s1_stream_transitions, f"{trading.STATUSES} SELECT order_id, id, ts, status FROM v_status QUALIFY lag(status) OVER (PARTITION BY order_id ORDER BY ts, id) IS DISTINCT FROM status"),
    "s1_transitions_in_run": (s1_transitions_in_run, S1_RUN),
    "s3_stream_latest_quotes": (s3_stream_latest_quotes, "SELECT upper(event_type) AS symbol, max(ts) AS ts, arg_max(value, ts) - 0.5 AS bid, arg_max(value, ts) + 0.5 AS ask, arg_max(value, ts) AS last FROM events GROUP BY 1"),
    "s4_stream_bars": (s4_stream_bars, S4),
    "s5_stream_build_bars": (s5_stream_build_bars, f"{d.MARKET} SELECT symbol, ts, open, high, low, close, volume FROM v_bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"),
    "s6_stream_evaluate": (s6_stream_evaluate, f"SELECT run_id, seq, CAST(reason IS NULL AS INTEGER) AS accepted, reason FROM ({trading.E6})"),
}
