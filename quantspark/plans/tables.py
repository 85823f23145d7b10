"""Queries that write tables and read them again, and strategies in Python."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantspark.operators import risk
from quantspark.plans import domain as d
from quantspark.plans import trading
from quantspark.plans.backtest import pandas_signal, run_backtests
from quantspark.schemas import AUDIT
from quantspark.sources.audit import append_audit, compact_audit, create_audit_tables, current_audit_orders, drop_compacted_batches, insert_audit, read_audit
from quantspark.sources.bars import read_bar_store, read_bars, write_bar_store, write_bars
from quantspark.sources.shared import shared_dir


def a1_csv_round_trip(spark, sf):
    """All bars written as CSV by symbol and read again."""
    path = f"{shared_dir(spark)}/bars-csv-{uuid.uuid4().hex}"
    write_bars(d.bars(spark, sf).withColumn("ts_epoch_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), path)
    return read_bars(spark, path).drop("ingest_seq")


A1 = f"{d.MARKET} SELECT symbol, CAST(epoch(ts) AS DOUBLE) AS ts_epoch_s, open, high, low, close, volume, bar_seq FROM v_bars"


def a11_append_audit(spark, sf):
    """Decisions of all risk checks appended to the audit table, and read again."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    judged = risk.evaluate_risk(d.table(spark, sf, "orders").selectExpr(*d.spark_exprs(trading.RISK)).withColumns({c: F.col(c).cast("double") for c in ("quantity", "net_liquidation")}))
    rows = judged.select("run_id", "seq", F.col("seq").cast("double").alias("ts_epoch_s"), F.lit("batch").alias("strategy"), F.col("side").alias("intent_json"), F.col("reason").isNull().cast("int").alias("accepted"), "reason")
    append_audit(rows, "decisions", path)
    return read_audit(spark, "decisions", path).select("run_id", "seq", "strategy", "accepted", "reason")


#: Rows of every audit table, from orders; some columns are null.
AUDIT_ROWS = {
    "run_id": "concat('run', o_custkey % 20)", "seq": "o_orderkey", "ts_epoch_s": "CAST(o_orderkey AS DOUBLE)", "accepted": "CAST(o_orderkey % 2 AS INT)",
    "quantity": "CAST(o_orderkey % 9 AS DOUBLE)", "filled": "CAST(o_orderkey % 7 AS DOUBLE)", "remaining": "CAST(o_orderkey % 5 AS DOUBLE)", "avg_fill_price": "CAST(NULL AS DOUBLE)", "reason": "CAST(NULL AS STRING)",
}


def a11_audit_tables(spark, sf):
    """Rows of all six tables, some appended and the others written as two micro-batches, of which one comes twice; read again and counted."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    orders = d.table(spark, sf, "orders")
    counts = None
    for name, ddl in AUDIT.items():
        columns = StructType.fromDDL(ddl).names
        rows = orders.select(F.expr("o_orderkey % 3").alias("how"), *[F.expr(AUDIT_ROWS.get(c, f"concat('{c}', o_orderkey)")).alias(c) for c in columns])
        append_audit(rows.filter("how = 0"), name, path)
        for k in (1, 2, 1):
            append_audit(rows.filter(F.col("how") == k), name, path, k)
        found = read_audit(spark, name, path)
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns if c != "ts_epoch_s" and dict(found.dtypes)[c] in ("string", "int")])
        part = found.groupBy(F.lit(name).alias("table_name"), "run_id").agg(F.count("*").alias("n"), F.sum("ts_epoch_s").alias("ts_sum"), F.max(text).alias("last_text"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


def a7_bar_store(spark, sf):
    """Ten days of two symbols from a bar store."""
    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    write_bar_store(d.bars(spark, sf), path)
    return read_bar_store(spark, path, "1705708800", "10 D", ["VIEW", "CLICK"]).select("symbol", "ts", "open", "high", "low", "close", "volume")


def a11_compacted_batches(spark, sf):
    """Decisions in seven micro-batches, compacted twice on the way, with one batch that comes again; counted by run."""
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    columns = StructType.fromDDL(AUDIT["decisions"]).names
    rows = d.table(spark, sf, "orders").select(F.expr("o_orderkey % 7").alias("how"), *[F.expr(AUDIT_ROWS.get(c, f"concat('{c}', o_orderkey)")).alias(c) for c in columns])
    for k in range(7):
        append_audit(rows.filter(F.col("how") == k), "decisions", path, k)
        if k in (2, 4):
            compact_audit(spark, "decisions", path)
            drop_compacted_batches(spark, "decisions", path)
    append_audit(rows.filter("how = 6"), "decisions", path, 6)
    return read_audit(spark, "decisions", path).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"), F.max("strategy").alias("last_strategy"))


def a13_audit_tables(spark, sf):
    """Orders and status events in bucketed tables, and each order's current status from them."""
    database = f"audit_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    create_audit_tables(spark, database)
    run = F.expr("concat('run', seq % 3)").alias("run_id")
    insert_audit(d.audit_orders(spark, sf).select("*", *_missing("orders", "order_id", "seq", "status", "run_id"), run), "orders", database)
    events = d.status_feed(spark, sf).select("order_id", F.col("id").alias("seq"), "status", "run_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_epoch_s"))
    insert_audit(events.select("*", *_missing("order_status_events", *events.columns)), "order_status_events", database)
    return current_audit_orders(spark, database).select("seq", "order_id", "status")


def _missing(name, *there):
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(AUDIT[name]) if f.name not in there]


def _audit_sql():
    """The same counts from the rows themselves."""
    parts = []
    for name, ddl in AUDIT.items():
        kinds = [c.split() for c in ddl.split(", ")]
        value = lambda c: AUDIT_ROWS.get(c, f"concat('{c}', o_orderkey)").replace("AS STRING", "AS VARCHAR")
        text = ", ".join(f"coalesce(CAST({value(c)} AS VARCHAR), '-')" for c, k in kinds if k in ("string", "int"))
        parts.append(f"SELECT '{name}' AS table_name, concat('run', o_custkey % 20) AS run_id, count(*) AS n, sum(CAST(o_orderkey AS DOUBLE)) AS ts_sum, max(concat_ws('|', {text})) AS last_text FROM orders GROUP BY 2")
    return " UNION ALL ".join(parts)


def _dip(bars):
    """Buys a bar after each close that is below half of the open."""
    import pandas as pd

    hit = bars[bars["close"] < bars["open"] / 2]
    return pd.DataFrame({"symbol": hit["symbol"], "order_key": hit["bar_seq"], "submit_seq": hit["bar_seq"] + 1, "side": "BUY", "quantity": 1.0, "order_type": "MKT", "limit_price": None, "stop_price": None})


def u1_pandas_signal(spark, sf):
    out = run_backtests(d.bars(spark, sf), pandas_signal(_dip), [("dip", 0.0, 0.0)])
    return out.withColumns({c: F.round(c, 4) for c in ("end_equity", "return_pct")})


def u1_chunked_signal(spark, sf):
    """The same strategy on 50 bars at a time."""
    out = run_backtests(d.bars(spark, sf), pandas_signal(_dip, 50), [("dip", 0.0, 0.0)])
    return out.withColumns({c: F.round(c, 4) for c in ("end_equity", "return_pct")})


U1 = f"""{d.MARKET}, t AS (SELECT b.symbol, sum(n.open) AS spent, count(*) AS k FROM v_bars b JOIN v_bars n ON n.symbol = b.symbol AND n.bar_seq = b.bar_seq + 1 WHERE b.close < b.open / 2 GROUP BY 1),
l AS (SELECT symbol, arg_max(close, bar_seq) AS c FROM v_bars GROUP BY 1)
SELECT 'dip' AS run_id, symbol, 100000.0::DOUBLE AS start_equity, round(100000 - spent + k * c, 4) AS end_equity, round((k * c - spent) / 100000 * 100, 4) AS return_pct FROM t JOIN l USING (symbol)"""

QUERIES = {
    "a7_bar_store": (a7_bar_store, f"{d.MARKET} SELECT symbol, ts, open, high, low, close, volume FROM v_bars WHERE symbol IN ('VIEW', 'CLICK') AND ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'"),
    "a11_compacted_batches": (a11_compacted_batches, "SELECT concat('run', o_custkey % 20) AS run_id, count(*) AS n, sum(o_orderkey)::BIGINT AS seq_sum, max(concat('strategy', o_orderkey)) AS last_strategy FROM orders GROUP BY 1"),
    "a13_audit_tables": (a13_audit_tables, f"WITH {d.V_STATUS}, {d.V_ORDERS}, l AS (SELECT order_id, arg_max(status, (ts, id)) AS s FROM v_status GROUP BY 1) SELECT seq, order_id, coalesce(s, status) AS status FROM v_orders LEFT JOIN l USING (order_id)"),
    "u1_chunked_signal": (u1_chunked_signal, U1),
    "a1_csv_round_trip": (a1_csv_round_trip, A1),
    "a11_append_audit": (a11_append_audit, f"SELECT run_id, seq, 'batch' AS strategy, CAST(reason IS NULL AS INTEGER) AS accepted, reason FROM ({trading.E6})"),
    "a11_audit_tables": (a11_audit_tables, _audit_sql()),
    "u1_pandas_signal": (u1_pandas_signal, U1),
}
