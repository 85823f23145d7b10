"""Queries on instruments, orders, risk, audit tables and decision logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.functions import instruments as inst
from quantspark.functions import orders as order_rules
from quantspark.functions.text import audit_json, strip_fences
from quantspark.operators import audit, decisions, ledger, risk
from quantspark.plans import domain as d
from quantspark.plans.market import QUOTE
from quantspark.sources.audit import runs_view

#: Raw instruments with every kind of fault, by part.
INSTRUMENT = {
    "kind": "CASE p_partkey % 5 WHEN 0 THEN 'stk' WHEN 1 THEN 'FUT' WHEN 2 THEN 'fx' WHEN 3 THEN 'opt' ELSE 'STK' END",
    "symbol": "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'eurusd' WHEN 2 THEN 'eur/usd' ELSE concat('sym', p_partkey % 50) END",
    "exchange": "CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'cme' ELSE '' END",
    "currency": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'eur' WHEN 2 THEN '' ELSE 'usd' END",
    "expiry": "CASE p_partkey % 6 WHEN 0 THEN '202503' WHEN 1 THEN '20250315' WHEN 2 THEN 'BAD' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE '2025' END",
}
N_INSTRUMENT = f"""n AS (SELECT p_partkey, upper(kind) AS kind, upper(symbol) AS symbol, nullif(upper(exchange), '') AS exchange, nullif(upper(currency), '') AS currency, nullif(expiry, '') AS expiry
  FROM (SELECT p_partkey, {d.sql_exprs(INSTRUMENT)} FROM part))"""
#: Raw orders with every kind of fault, by order.
ORDER = {
    "side": "CASE o_orderkey % 11 WHEN 0 THEN 'hold' WHEN 1 THEN ' sell ' ELSE 'buy' END",
    "quantity": "CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE CAST(o_orderkey % 9 + 1 AS DOUBLE) END",
    "order_type": "CASE o_orderkey % 6 WHEN 0 THEN 'mkt' WHEN 1 THEN 'LMT' WHEN 2 THEN ' stp' WHEN 3 THEN 'STPLMT' WHEN 4 THEN 'TRAIL' ELSE 'lmt' END",
    "limit_price": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE 100.0 END",
    "stop_price": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE 99.0 END",
    "tif": "CASE o_orderkey % 17 WHEN 0 THEN ' ' WHEN 1 THEN 'gtd' ELSE 'day' END",
    "good_till_date": "CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' 20250101 ' END",
}
N_ORDER = f"""n AS (SELECT o_orderkey, upper(trim(side)) AS side, CAST(quantity AS DOUBLE) AS quantity, upper(trim(order_type)) AS order_type, CAST(limit_price AS DOUBLE) AS limit_price,
  CAST(stop_price AS DOUBLE) AS stop_price, upper(trim(tif)) AS tif, nullif(trim(good_till_date), '') AS good_till_date FROM (SELECT o_orderkey, {d.sql_exprs(ORDER)} FROM orders))"""
GATE = {
    "broker": "CASE WHEN o_orderkey % 4 = 0 THEN 'sim' ELSE 'ibkr' END", "live": "o_orderkey % 3 <> 0", "dry_run": "o_orderkey % 5 = 0", "token_required": "o_orderkey % 2 = 0",
    "token": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'secret' END", "confirm": "CASE WHEN o_orderkey % 11 = 0 THEN 'other' ELSE 'secret' END",
}


def _raw_instruments(spark, sf):
    return d.table(spark, sf, "part").selectExpr("p_partkey", *d.spark_exprs(INSTRUMENT))


def _raw_orders(spark, sf):
    return d.table(spark, sf, "orders").selectExpr("o_orderkey", *d.spark_exprs(ORDER)).withColumns({c: F.col(c).cast("double") for c in ("quantity", "limit_price", "stop_price")})


def b3_contracts(spark, sf):
    rows = d.table(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'stk' WHEN 1 THEN 'FUT' WHEN 2 THEN 'CASH' ELSE 'OPT' END AS sec_type", "CASE WHEN p_partkey % 4 = 2 THEN 'eur' ELSE concat('s', p_partkey % 9) END AS symbol", "CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'cme' END AS exchange", "CASE p_partkey % 5 WHEN 0 THEN '' ELSE 'usd' END AS currency", "CASE p_partkey % 6 WHEN 1 THEN ' 202503 ' ELSE 'X' END AS contract_month")
    return inst.contract_to_instrument(rows).select("p_partkey", *inst.FIELDS, "error").filter("error is null").drop("error")


B3 = """WITH r AS (SELECT p_partkey, p_partkey % 4 AS k, CASE WHEN p_partkey % 4 = 2 THEN 'EUR' ELSE concat('S', p_partkey % 9) END AS s, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'CME' END AS x, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE 'USD' END AS c, p_partkey % 6 = 1 AS good FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'STK' WHEN 1 THEN 'FUT' ELSE 'FX' END AS kind, CASE WHEN k = 2 THEN s || c ELSE s END AS symbol, coalesce(x, CASE k WHEN 0 THEN 'SMART' WHEN 2 THEN 'IDEALPRO' END) AS exchange,
  CASE WHEN k <> 2 THEN coalesce(c, 'USD') END AS currency, CASE WHEN k = 1 THEN '202503' END AS expiry FROM r WHERE k = 0 OR (k = 1 AND x IS NOT NULL AND good) OR (k = 2 AND c IS NOT NULL)"""
B2 = f"""WITH {N_INSTRUMENT} SELECT p_partkey, kind, symbol, CASE kind WHEN 'STK' THEN coalesce(exchange, 'SMART') WHEN 'FX' THEN coalesce(exchange, 'IDEALPRO') ELSE exchange END AS exchange,
  CASE WHEN kind IN ('STK', 'FUT') THEN coalesce(currency, 'USD') WHEN kind <> 'FX' THEN currency END AS currency, CASE WHEN kind NOT IN ('STK', 'FX') THEN expiry END AS expiry,
  CASE WHEN kind NOT IN ('STK', 'FUT', 'FX') THEN 'Unsupported instrument kind: ' || kind WHEN symbol = '' THEN 'Instrument symbol is required'
    WHEN kind = 'FUT' AND exchange IS NULL THEN 'FUT exchange is required (e.g. CME)'
    WHEN kind = 'FUT' AND NOT coalesce(regexp_matches(expiry, '^\\d{{6}}(\\d{{2}})?$'), false) THEN 'FUT expiry must be YYYYMM or YYYYMMDD (e.g. 202503 or 20250315)'
    WHEN kind = 'FX' AND NOT regexp_matches(symbol, '^[A-Z]{{6}}$') THEN 'FX symbol must be a 6-letter pair like EURUSD' END AS error FROM n"""
B5 = f"""WITH {N_ORDER} SELECT o_orderkey, CASE WHEN side NOT IN ('BUY', 'SELL') THEN 'side must be BUY or SELL' WHEN quantity <= 0 THEN 'quantity must be positive'
  WHEN order_type NOT IN ('MKT', 'LMT', 'STP', 'STPLMT') THEN 'order_type must be MKT, LMT, STP, or STPLMT' WHEN order_type = 'LMT' AND limit_price IS NULL THEN 'limit_price is required for LMT orders'
  WHEN order_type = 'LMT' AND limit_price <= 0 THEN 'limit_price must be positive' WHEN order_type IN ('STP', 'STPLMT') AND coalesce(stop_price, 0) <= 0 THEN 'stop_price is required and must be positive for ' || order_type || ' orders'
  WHEN order_type = 'STPLMT' AND coalesce(limit_price, 0) <= 0 THEN 'limit_price is required and must be positive for STPLMT orders' WHEN tif = '' THEN 'tif is required'
  WHEN tif = 'GTD' AND good_till_date IS NULL THEN 'good_till_date is required for GTD tif' END AS error FROM n"""
B13 = f"""WITH {N_INSTRUMENT} SELECT p_partkey, CASE WHEN kind NOT IN ('STK', 'FX') THEN 'Instrument kind not allowed: ' || kind WHEN symbol NOT IN ('SYM1', 'SYM2', 'EURUSD') THEN 'Symbol not allowed: ' || symbol END AS reason FROM n"""


def b6_intents_to_orders(spark, sf):
    out = order_rules.intents_to_orders(d.intents(spark, sf).withColumn("tif", F.lit("DAY")))
    return out.select("order_key", "side", "quantity", "order_type", "tif", "outside_rth", "transmit", "good_till_date")


def b15_brackets(spark, sf):
    rows = d.intents(spark, sf).select(F.col("order_key").alias("bracket_id"), "side", "quantity", F.col("px").alias("entry_limit"), (F.col("px") * 2).alias("take_profit"), (F.col("px") - 5).alias("stop_loss"))
    return order_rules.expand_brackets(rows)


B15 = f"""{d.ORDERED}, b AS (SELECT order_key, side, CASE WHEN side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS other, quantity, px FROM v_intents WHERE px > 0 AND px - 5 > 0)
SELECT order_key AS bracket_id, 0 AS leg_no, quantity, 'entry' AS leg, side, 'LMT' AS order_type, px AS limit_price, NULL::DOUBLE AS stop_price FROM b
UNION ALL SELECT order_key, 1, quantity, 'take_profit', other, 'LMT', px * 2, NULL FROM b UNION ALL SELECT order_key, 2, quantity, 'stop_loss', other, 'STP', NULL, px - 5 FROM b"""


def b14_gate(engine):
    return lambda spark, sf: risk.classify_gate(d.table(spark, sf, "orders").selectExpr("o_orderkey", *d.spark_exprs(GATE)), engine).select("o_orderkey", "gate")


V_GATE = f"WITH g AS (SELECT o_orderkey, {d.sql_exprs(GATE)} FROM orders)"
B14 = f"""{V_GATE} SELECT o_orderkey, CASE WHEN broker = 'ibkr' AND NOT live THEN 'live_disabled' WHEN broker = 'ibkr' AND token_required AND coalesce(token, '') = '' THEN 'missing_order_token'
  WHEN broker = 'ibkr' AND token_required AND confirm <> token THEN 'confirm_token_mismatch' WHEN dry_run THEN 'dry_run' ELSE 'send' END AS gate FROM g"""
B14_ENGINE = f"""{V_GATE} SELECT o_orderkey, CASE WHEN dry_run THEN 'dry_run' WHEN broker = 'ibkr' AND NOT live THEN 'live_disabled' WHEN broker = 'ibkr' AND coalesce(token, '') = '' THEN 'missing_order_token'
  WHEN broker = 'ibkr' AND confirm <> token THEN 'confirm_token_mismatch' ELSE 'send' END AS gate FROM g"""

#: Order ids of the audit orders that the broker has open, and those that it can look up.
OPEN, KNOWN = "custkey % 3 = 0", "custkey % 3 = 1"


def _broker(spark, sf, where, status):
    return d.audit_orders(spark, sf).filter(where).select("order_id").distinct().withColumn("status", F.lit(status))


def c4_reconcile(spark, sf):
    return audit.reconcile(d.audit_orders(spark, sf), _broker(spark, sf, OPEN, "Submitted"), _broker(spark, sf, KNOWN, "Cancelled"))


def c5_reconcile_errors(spark, sf):
    return audit.reconcile_errors(d.audit_orders(spark, sf), _broker(spark, sf, OPEN, "Submitted"), _broker(spark, sf, KNOWN, "Cancelled"))


LIVE = f"WITH {d.V_ORDERS}, t AS (SELECT DISTINCT order_id, custkey FROM v_orders WHERE status <> 'Filled')"
D7 = f"{LIVE} SELECT DISTINCT order_id, 'broker' AS origin FROM v_orders WHERE {OPEN} UNION ALL SELECT order_id, 'store' FROM t WHERE NOT ({OPEN})"


def d7_orders_to_track(spark, sf):
    return audit.orders_to_track(_broker(spark, sf, OPEN, "Submitted"), d.audit_orders(spark, sf))


POSITION = ["CASE WHEN l_partkey % 4 = 0 THEN 'FUT' ELSE 'STK' END AS kind", "concat('P', l_partkey) AS symbol", "CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity"]


def _positions(spark, sf):
    return d.table(spark, sf, "lineitem").selectExpr(*POSITION)


D1 = f"SELECT kind, symbol, sum(quantity) AS quantity FROM (SELECT {', '.join(POSITION)} FROM lineitem) GROUP BY 1, 2"


def c7_position_for_intents(spark, sf):
    rows = d.table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 8 = 0 THEN 'FUT' ELSE 'STK' END AS kind", "concat('P', p_partkey) AS symbol")
    return risk.position_for_intents(rows, _positions(spark, sf))


C7 = f"""SELECT p_partkey, kind, symbol, coalesce(quantity, 0) AS position FROM (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'FUT' ELSE 'STK' END AS kind, concat('P', p_partkey) AS symbol FROM part) LEFT JOIN ({D1}) USING (kind, symbol)"""


def d8_exposure(spark, sf):
    held = d.table(spark, sf, "orders").selectExpr("o_custkey AS account", "CASE WHEN o_orderkey % 2 = 0 THEN -1.0D ELSE 2.0D END AS quantity", "CAST(floor(o_totalprice) AS DOUBLE) AS close")
    accounts = d.table(spark, sf, "customer").selectExpr("c_custkey AS account", "CASE WHEN c_custkey % 10 = 0 THEN 0.0D ELSE c_acctbal END AS net_liquidation", "1000.0D AS maint_margin_req")
    return ledger.exposure_metrics(held, accounts)


D8 = """WITH g AS (SELECT o_custkey AS account, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 2.0 END * floor(o_totalprice)) AS v FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS account, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE nullif(c_acctbal, 0) END AS net FROM customer)
SELECT account, coalesce(v, 0.0) AS gross_position_value, coalesce(v, 0.0) / net AS leverage, 1000.0::DOUBLE / net AS margin_utilization FROM a LEFT JOIN g USING (account)"""

#: Intents with all values that the risk rules read, by order; a run has many accounts' worth of orders.
RISK = {
    "run_id": "concat('run', o_custkey % 20)", "seq": "o_orderkey", "side": "CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END",
    "quantity": "CASE WHEN o_orderkey % 31 = 0 THEN 0.0 ELSE CAST(o_orderkey % 110 AS DOUBLE) END", "position": "CAST(o_orderkey % 450 AS DOUBLE)",
    "px": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 100 + 1 AS DOUBLE) END",
    "net_liquidation": "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN -1.0 WHEN o_orderkey % 37 = 1 THEN CAST('NaN' AS DOUBLE) ELSE 100000.0 - o_orderkey % 1500 END",
    "gross_position_value": "CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 41 = 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_orderkey % 250 * 1000 AS DOUBLE) END",
    "maint_margin_req": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 60 * 1000 AS DOUBLE) END",
}
V_START = """v_start AS (SELECT *, first_value(CASE WHEN quantity > 0 AND quantity <= 100 AND net > 0 AND NOT isnan(net) THEN net END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session_start
  FROM (SELECT *, position + CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS resulting FROM v_risk))"""
V_RISK = f"""v_risk AS (SELECT run_id, seq, side, CAST(quantity AS DOUBLE) AS quantity, position, px, CAST(net_liquidation AS DOUBLE) AS net, gross_position_value AS gross, maint_margin_req AS maint
  FROM (SELECT {d.sql_exprs(RISK)} FROM orders)), {V_START}"""
REASON = """CASE WHEN quantity <= 0 THEN 'quantity must be positive' WHEN quantity > 100 THEN 'order quantity exceeds max_order_quantity'
  WHEN resulting < 0 THEN 'order would create a short position (allow_short=false)' WHEN abs(resulting) > 500 THEN 'resulting position exceeds max_abs_position_per_symbol' WHEN px IS NULL THEN 'no usable price'
  WHEN gross + quantity * px > 250000 AND NOT isnan(gross) THEN 'max_notional_exposure exceeded' WHEN net <= 0 AND gross IS NOT NULL THEN 'Invalid NetLiquidation' WHEN net > 0 AND gross / net > 2 AND NOT isnan(gross / net) THEN 'max_leverage exceeded'
  WHEN net <= 0 AND maint IS NOT NULL THEN 'Invalid NetLiquidation' WHEN net > 0 AND maint / net > 0.5 AND NOT isnan(maint / net) THEN 'max_margin_utilization exceeded' WHEN session_start - net > 1000 AND NOT isnan(net) THEN 'max_daily_loss exceeded (circuit breaker)' END AS reason"""
E6 = f"WITH {V_RISK} SELECT run_id, seq, {REASON} FROM v_start"
E7 = f"WITH {V_RISK} SELECT run_id, seq, session_start, coalesce(session_start - net > 1000 AND NOT isnan(net), false) AS tripped FROM v_start"

#: Positions by symbol of the ticks, from nations.
HELD = {
    "kind": "CASE WHEN n_nationkey % 7 = 6 THEN 'FUT' ELSE 'STK' END",
    "symbol": "CASE n_nationkey % 4 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'PURCHASE' ELSE 'ERROR' END", "quantity": "CAST(n_nationkey * 3 AS DOUBLE)",
}


def c8_account_for_intents(spark, sf):
    """All intents with the account values that were known at their time."""
    return risk.account_for_intents(d.intents(spark, sf).select("order_key", "account", "ts"), d.accounts(spark, sf), order="seq").select("order_key", *risk.ACCOUNT_VALUES)


AS_OF = f"{d.ORDERED}, {d.V_ACCOUNTS}, a AS (SELECT i.order_key, x.net_liquidation, x.gross_position_value, x.maint_margin_req FROM v_intents i ASOF LEFT JOIN v_accounts x ON i.account = x.account AND i.ts >= x.ts)"


def e6_risk_from_feeds(spark, sf):
    """All intents judged with positions, quotes no older than a day, and account snapshots, each joined as of the intent."""
    intents = d.intents(spark, sf).select("run_id", F.col("order_key").alias("seq"), F.lit("STK").alias("kind"), "symbol", "account", "ts", "side", "quantity")
    held = d.table(spark, sf, "nation").selectExpr(*d.spark_exprs(HELD))
    quotes = d.bars(spark, sf).selectExpr("symbol", "ts", "volume", *d.spark_exprs(QUOTE))
    rows = risk.risk_inputs(intents, held, quotes, d.accounts(spark, sf), 86400.0, "seq")
    return risk.evaluate_risk(rows).select("run_id", "seq", "px", "position", "reason")


E6_FEEDS = f"""{AS_OF}, v_quotes AS (SELECT symbol, ts, bar_seq, volume, {d.sql_exprs(QUOTE)} FROM v_bars),
p AS (SELECT symbol, sum(quantity) AS position FROM (SELECT {d.sql_exprs(HELD)} FROM nation) WHERE kind = 'STK' GROUP BY 1),
q AS (SELECT i.order_key, CASE WHEN epoch(i.ts) - epoch(q.ts) <= 86400 THEN CASE WHEN last > 0 THEN last WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 WHEN close > 0 THEN close END END AS px
  FROM v_intents i ASOF LEFT JOIN v_quotes q ON i.symbol = q.symbol AND i.ts >= q.ts),
v_risk AS (SELECT run_id, order_key AS seq, side, quantity, coalesce(position, 0.0) AS position, q.px AS px, net_liquidation AS net, gross_position_value AS gross, maint_margin_req AS maint
  FROM v_intents JOIN a USING (order_key) JOIN q USING (order_key) LEFT JOIN p USING (symbol)), {V_START}
SELECT run_id, seq, px, position, {REASON} FROM v_start"""


def _risk_rows(spark, sf):
    rows = d.table(spark, sf, "orders").selectExpr(*d.spark_exprs(RISK))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("quantity", "net_liquidation")})


def a12_runs(spark, sf):
    """Each order date starts a run, and two thirds of the runs end."""
    starts = d.table(spark, sf, "orders").selectExpr("concat('r', o_custkey) AS run_id", "'start' AS event", "CAST(o_orderkey AS DOUBLE) AS ts_epoch_s")
    ends = starts.filter("cast(substr(run_id, 2) as int) % 3 > 0").withColumns({"event": F.lit("end"), "ts_epoch_s": F.col("ts_epoch_s") + 60})
    return runs_view(starts.union(ends))


A12 = "SELECT concat('r', o_custkey) AS run_id, min(o_orderkey)::DOUBLE AS started_epoch_s, CASE WHEN o_custkey % 3 > 0 THEN max(o_orderkey)::DOUBLE + 60 END AS ended_epoch_s FROM orders GROUP BY o_custkey"


def d6_audit_counts(spark, sf):
    rows = risk.evaluate_risk(_risk_rows(spark, sf)).select("run_id", "reason", F.col("reason").isNull().cast("int").alias("accepted"))
    return audit.audit_counts(rows)


EVENT = ["concat('o', user_id) AS order_id", "event_id AS seq", "CASE event_type WHEN 'signup' THEN 'PLACE' WHEN 'view' THEN 'MODIFY' WHEN 'click' THEN 'MODIFY' WHEN 'purchase' THEN 'FILL' ELSE 'CANCEL' END AS event", "CAST(event_id % 90 + 1 AS DOUBLE) AS quantity"]


def e11_order_state(sticky):
    return lambda spark, sf: audit.order_state(d.table(spark, sf, "events").selectExpr(*EVENT), sticky)


def E11(sticky):  # noqa: N802
    pick = "arg_min" if sticky else "arg_max"
    filled = "e = 'FILL'" if sticky else "fills > 0"
    return f"""WITH v AS (SELECT {', '.join(EVENT)} FROM events), s AS (SELECT order_id, {pick}(event, seq) FILTER (event IN ('FILL', 'CANCEL')) AS e, arg_max(quantity, seq) FILTER (event IN ('PLACE', 'MODIFY')) AS q, count(*) FILTER (event = 'FILL') AS fills FROM v GROUP BY 1)
SELECT order_id, CASE e WHEN 'FILL' THEN 'Filled' WHEN 'CANCEL' THEN 'Cancelled' ELSE 'Submitted' END AS status, q AS quantity, CASE WHEN {filled} THEN q ELSE 0.0::DOUBLE END AS filled FROM s"""


def j2_parse_decisions(spark, sf):
    return decisions.parse_decisions(d.responses(spark, sf)).select("resp_id", F.coalesce("decision_no", F.lit(-1)).alias("decision_no"), "action", "order_id", "symbol", "exchange", "side", "quantity", "order_type", "tif", "response_error")


J2 = f"""WITH {d.V_TICKS}, {d.V_RAW}, t AS (SELECT resp_id, raw, trim(regexp_replace(regexp_replace(raw, '^```[^\\n]*\\n', ''), '\\n```$', '')) AS txt FROM v_raw),
j AS (SELECT resp_id, CAST(txt AS JSON) AS j FROM t WHERE json_valid(txt) AND starts_with(txt, '{{')),
i AS (SELECT resp_id, unnest(from_json(j->'decisions', '["JSON"]')) AS d, generate_subscripts(from_json(j->'decisions', '["JSON"]'), 1) - 1 AS decision_no FROM j)
SELECT resp_id, CAST(decision_no AS INTEGER) AS decision_no, upper(d->>'action') AS action, d->>'order_id' AS order_id, upper(d->'order'->'instrument'->>'symbol') AS symbol, CASE WHEN (d->'order') IS NOT NULL THEN 'SMART' END AS exchange,
  d->'order'->>'side' AS side, CAST(d->'order'->>'qty' AS DOUBLE) AS quantity, d->'order'->>'type' AS order_type, CASE WHEN (d->'order') IS NOT NULL THEN 'DAY' END AS tif, NULL::VARCHAR AS response_error FROM i
UNION ALL SELECT resp_id, -1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'LLM output is not valid JSON' FROM t WHERE NOT json_valid(txt)"""


def j3_enforce_limits(spark, sf):
    return decisions.limit_responses(d.responses(spark, sf), ["STK"], ["CLICK", "VIEW", "PURCHASE"], 2, 5.0)


J3 = f"""WITH {d.V_TICKS}, r AS (SELECT event_id AS resp_id, symbol, {d.INTENT['quantity']} AS q FROM v_ticks WHERE event_id % 100 <> 0)
SELECT resp_id, 2::BIGINT AS n_decisions, CASE WHEN symbol NOT IN ('CLICK', 'VIEW', 'PURCHASE') THEN 'Symbol not allowed: ' || symbol WHEN q > 5 THEN 'Quantity too large: ' || q || ' > 5.0' END AS verdict FROM r"""

#: Assistant replies and vendor contents, as JSON built from the conversation table.
REPLY = """CASE turn % 3 WHEN 0 THEN concat('{"assistant_message":"m', conv_id, '","tool_calls":[{"id":"c1","name":" get_quote ","args":{"symbol":"S', turn, '"}},{"name":""},7,{"name":"cancel","args":[1]}]}') WHEN 1 THEN concat('plain ', conv_id) ELSE concat('```json', chr(10), '{"assistant_message":"only text"}', chr(10), '```') END"""
CONTENT = """concat('{"parts":[{"text":"a', turn, '"},{"functionCall":{"name":"place_order","args":{"qty":', conv_id, '}}},{"text":"b"},{"functionCall":{"name":" "}},{"functionCall":{"name":"noop"}}]}')"""


def j4_parse_replies(spark, sf):
    rows = d.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS reply_id", f"{REPLY} AS raw")
    return decisions.parse_replies(rows).withColumn("call_no", F.coalesce("call_no", F.lit(-1)))


J4 = """WITH r AS (SELECT conv_id * 1000 + turn AS reply_id, conv_id, turn FROM conversations)
SELECT reply_id, 'm' || conv_id AS message, 0::INTEGER AS call_no, 'c1' AS call_id, 'get_quote' AS name, '{"symbol":"S' || turn || '"}' AS args FROM r WHERE turn % 3 = 0
UNION ALL SELECT reply_id, 'm' || conv_id, 1, NULL, 'cancel', '{}' FROM r WHERE turn % 3 = 0 UNION ALL SELECT reply_id, 'plain ' || conv_id, -1, NULL, NULL, NULL FROM r WHERE turn % 3 = 1
UNION ALL SELECT reply_id, 'only text', -1, NULL, NULL, NULL FROM r WHERE turn % 3 = 2"""


def j5_extract_tool_calls(spark, sf):
    rows = d.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS content_id", f"{CONTENT} AS content")
    return decisions.extract_tool_calls(rows)


J5 = """SELECT conv_id * 1000 + turn AS content_id, concat('a', turn, 'b') AS text, 0::INTEGER AS call_no, 'place_order' AS name, '{"qty":' || conv_id || '}' AS args FROM conversations
UNION ALL SELECT conv_id * 1000 + turn, concat('a', turn, 'b'), 1, 'noop', '{}' FROM conversations"""


def j6_audit_json(spark, sf):
    fields = {"side": F.col("side"), "order_type": F.col("order_type"), "quantity": F.col("quantity").cast("int"), "account": F.lit(None).cast("string")}
    return d.intents(spark, sf).select("order_key", audit_json(fields).alias("intent_json"))


J6 = f"""{d.ORDERED} SELECT order_key, concat('{{"account":null,"order_type":"', order_type, '","quantity":', CAST(quantity AS BIGINT), ',"side":"', side, '"}}') AS intent_json FROM v_intents"""


def j6_tool_results(spark, sf):
    """The result of each tool call of the replies, as the model gets it; those of one call in five failed."""
    rows = d.table(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS reply_id", f"{REPLY} AS raw")
    calls = decisions.parse_replies(rows).filter("name is not null")
    ok = F.col("reply_id") % 5 != 0
    result = F.create_map(F.lit("reply"), F.col("reply_id").cast("string"))
    return calls.select("reply_id", "call_no", decisions.tool_result_json(F.col("call_id"), F.col("name"), ok, F.when(ok, result)).alias("result_json"))


J6_TOOLS = """WITH r AS (SELECT conv_id * 1000 + turn AS reply_id FROM conversations WHERE turn % 3 = 0),
c AS (SELECT reply_id, 0::INTEGER AS call_no, '"c1"' AS id, 'get_quote' AS name FROM r UNION ALL SELECT reply_id, 1, 'null', 'cancel' FROM r)
SELECT reply_id, call_no, concat('{"tool_result":{"id":', id, ',"name":"', name, '","ok":', CASE WHEN reply_id % 5 <> 0 THEN 'true' ELSE 'false' END, ',"result":', CASE WHEN reply_id % 5 <> 0 THEN concat('{"reply":"', reply_id, '"}') ELSE 'null' END, '}}') AS result_json FROM c"""


def j7_context_docs(spark, sf):
    """A tick for each customer: its orders are the positions and open orders, and quotes come from nations."""
    customer, orders = d.table(spark, sf, "customer"), d.table(spark, sf, "orders")
    accounts = customer.select(F.col("c_custkey").alias("tick"), F.create_map(F.lit("NetLiquidation"), F.col("c_custkey").cast("int")).alias("values"))
    positions = orders.selectExpr("o_custkey AS tick", "concat('S', o_orderkey) AS symbol", "'STK' AS kind", "o_orderkey AS qty", "CAST(NULL AS INT) AS avg_cost")
    open_orders = orders.selectExpr("o_custkey AS tick", "concat('o', o_orderkey) AS order_id", "'Submitted' AS status", "0 AS filled", "o_orderkey AS remaining")
    quotes = customer.selectExpr("c_custkey AS tick", "concat('N', c_nationkey) AS symbol", "CAST(NULL AS INT) AS bid", "c_nationkey AS ask", "CAST(NULL AS INT) AS last", "CASE WHEN c_nationkey = 3 THEN 'no data' END AS error")
    return decisions.build_context_docs(accounts, positions, open_orders, quotes)


J7 = """WITH o AS (SELECT o_custkey, string_agg('{"order_id":"o' || o_orderkey || '","status":"Submitted","filled":0,"remaining":' || o_orderkey || '}', ',' ORDER BY 'o' || o_orderkey) AS oo,
  string_agg('{"symbol":"S' || o_orderkey || '","kind":"STK","qty":' || o_orderkey || ',"avg_cost":null}', ',' ORDER BY 'S' || o_orderkey) AS pp FROM orders GROUP BY 1)
SELECT c_custkey AS tick, '{"account":{"NetLiquidation":' || c_custkey || '},"market_snapshots":{"N' || c_nationkey || '":{"ask":' || c_nationkey || ',"bid":null,"error":' || CASE WHEN c_nationkey = 3 THEN '"no data"' ELSE 'null' END || ',"last":null}},"open_orders":['
  || coalesce(oo, '') || '],"positions":[' || coalesce(pp, '') || ']}' AS context_json FROM customer LEFT JOIN o ON o_custkey = c_custkey"""


def j8_account_map(spark, sf):
    rows = d.table(spark, sf, "events").selectExpr("concat('a', user_id) AS account", "CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type END AS tag", "CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(event_id AS STRING) END AS value", "event_id AS seq")
    return decisions.account_map(rows).select("account", F.explode("values").alias("tag", "value"))


J8 = "SELECT concat('a', user_id) AS account, event_type AS tag, max(event_id)::DOUBLE AS value FROM events WHERE event_id % 9 <> 0 AND event_id % 4 <> 0 GROUP BY 1, 2"
STATUSES = f"WITH {d.V_STATUS}"
TERMINAL = ", ".join(f"'{s}'" for s in audit.TERMINAL)

QUERIES = {
    "a12_runs": (a12_runs, A12),
    "b1_normalize_instrument": (lambda s, sf: inst.normalize_instrument(_raw_instruments(s, sf)), f"WITH {N_INSTRUMENT} SELECT * FROM n"),
    "b2_validate_instrument": (lambda s, sf: inst.validate_instrument(_raw_instruments(s, sf)), B2),
    "b3_contracts": (b3_contracts, B3),
    "b4_normalize_orders": (lambda s, sf: order_rules.normalize_orders(_raw_orders(s, sf)), f"WITH {N_ORDER} SELECT * FROM n"),
    "b5_validate_orders": (lambda s, sf: order_rules.validate_orders(_raw_orders(s, sf)).select("o_orderkey", "error"), B5),
    "b6_intents_to_orders": (b6_intents_to_orders, f"{d.ORDERED} SELECT order_key, side, quantity, order_type, 'DAY' AS tif, false AS outside_rth, true AS transmit, NULL::VARCHAR AS good_till_date FROM v_intents"),
    "b12_terminal": (lambda s, sf: d.status_feed(s, sf).select("id", audit.is_terminal(F.col("status")).alias("terminal")), f"{STATUSES} SELECT id, status IN ({TERMINAL}) AS terminal FROM v_status"),
    "b13_allowlist": (lambda s, sf: inst.apply_allowlist(inst.normalize_instrument(_raw_instruments(s, sf)), ["stk", "FX"], ["sym1", "SYM2 ", "eurusd"]).select("p_partkey", "reason"), B13),
    "b14_gate_manager": (b14_gate(False), B14),
    "b14_gate_engine": (b14_gate(True), B14_ENGINE),
    "b15_brackets": (b15_brackets, B15),
    "c4_reconcile": (c4_reconcile, f"{LIVE} SELECT order_id, CASE custkey % 3 WHEN 0 THEN 'Submitted' WHEN 1 THEN 'Cancelled' END AS status FROM t"),
    "c5_reconcile_errors": (c5_reconcile_errors, f"{LIVE} SELECT 'oms.reconcile' AS where_text, concat('order_id=', order_id) AS message FROM t WHERE custkey % 3 = 2"),
    "c7_position_for_intents": (c7_position_for_intents, C7),
    "c8_account_for_intents": (c8_account_for_intents, f"{AS_OF} SELECT * FROM a"),
    "d1_net_positions": (lambda s, sf: ledger.net_positions(_positions(s, sf)), D1),
    "d5_non_terminal_orders": (lambda s, sf: audit.non_terminal_orders(d.audit_orders(s, sf)), f"{LIVE} SELECT order_id FROM t"),
    "d6_audit_counts": (d6_audit_counts, f"SELECT run_id, reason, count(*) AS n, count(*) FILTER (reason IS NULL) AS n_accepted FROM ({E6}) GROUP BY 1, 2"),
    "d6_status_event_counts": (lambda s, sf: audit.status_event_counts(d.status_feed(s, sf)), f"{STATUSES} SELECT order_id, count(*) AS n_events FROM v_status GROUP BY 1"),
    "d7_orders_to_track": (d7_orders_to_track, D7),
    "d8_exposure": (d8_exposure, D8),
    "e6_evaluate_risk": (lambda s, sf: risk.evaluate_risk(_risk_rows(s, sf)).select("run_id", "seq", "reason"), E6),
    "e6_risk_from_feeds": (e6_risk_from_feeds, E6_FEEDS),
    "e7_drawdown": (lambda s, sf: risk.drawdown_breaker(_risk_rows(s, sf)).select("run_id", "seq", "session_start", "tripped"), E7),
    "e8_status_transitions": (lambda s, sf: audit.status_transitions(d.status_feed(s, sf), ("run_id", "order_id")), f"{STATUSES} SELECT * FROM v_status QUALIFY lag(status) OVER (PARTITION BY run_id, order_id ORDER BY ts, id) IS DISTINCT FROM status"),
    "e9_latest_status": (lambda s, sf: audit.latest_status(d.status_feed(s, sf)), f"{STATUSES} SELECT order_id, arg_max(status, (ts, id)) AS status FROM v_status GROUP BY 1"),
    "e10_orders_current": (lambda s, sf: audit.orders_current(d.audit_orders(s, sf), d.status_feed(s, sf)).select("seq", "order_id", "status"), f"{STATUSES}, {d.V_ORDERS}, l AS (SELECT order_id, arg_max(status, (ts, id)) AS s FROM v_status GROUP BY 1) SELECT seq, order_id, coalesce(s, status) AS status FROM v_orders LEFT JOIN l USING (order_id)"),
    "e11_order_state_sticky": (e11_order_state(True), E11(True)),
    "e11_order_state_last": (e11_order_state(False), E11(False)),
    "j1_strip_fences": (lambda s, sf: d.responses(s, sf).select("resp_id", strip_fences(F.col("raw")).alias("text")), f"WITH {d.V_TICKS}, {d.V_RAW} SELECT resp_id, regexp_replace(regexp_replace(raw, '^```[^\\n]*\\n', ''), '\\n```$', '') AS text FROM v_raw"),
    "j2_parse_decisions": (j2_parse_decisions, J2),
    "j3_enforce_limits": (j3_enforce_limits, J3),
    "j4_parse_replies": (j4_parse_replies, J4),
    "j5_extract_tool_calls": (j5_extract_tool_calls, J5),
    "j6_audit_json": (j6_audit_json, J6),
    "j6_tool_results": (j6_tool_results, J6_TOOLS),
    "j7_context_docs": (j7_context_docs, J7),
    "j8_account_map": (j8_account_map, J8),
}
