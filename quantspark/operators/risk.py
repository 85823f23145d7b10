"""Pre-trade risk rules over intents with their position, price and account values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.compare import gt
from quantspark.functions.quotes import usable_price
from quantspark.functions.text import first_error
from quantspark.operators.asof import asof, asof_quotes
from quantspark.operators.ledger import signed

#: What the rules read of an account.
ACCOUNT_VALUES = ("net_liquidation", "gross_position_value", "maint_margin_req")


@dataclass(frozen=True)
class RiskLimits:
    """Defaults of the fixed rules."""

    max_order_quantity: float = 100.0
    max_abs_position: float = 500.0
    max_notional: float = 250000.0
    max_leverage: float = 2.0
    max_margin_utilization: float = 0.5
    max_daily_loss: float = 1000.0
    allow_short: bool = False


def position_for_intents(intents: DataFrame, positions: DataFrame) -> DataFrame:
    """intents with the position of their kind and symbol, over all accounts and exchanges; 0 without one."""
    net = positions.groupBy("kind", "symbol").agg(F.sum("quantity").alias("position"))
    return intents.join(net, ["kind", "symbol"], "left").withColumn("position", F.coalesce("position", F.lit(0.0)))


def account_for_intents(intents: DataFrame, accounts: DataFrame, key: str = "account", order: str | None = None) -> DataFrame:
    """intents with the values of their account's latest snapshot up to their own time, null without one.

    accounts(account, ts, net_liquidation, gross_position_value, maint_margin_req); order breaks ties of ts.
    """
    return asof(intents, accounts, [key], "ts", list(ACCOUNT_VALUES), order=order).drop("asof_ts")


def risk_inputs(intents: DataFrame, positions: DataFrame, quotes: DataFrame, accounts: DataFrame, ttl_s: float = 1.0, order: str | None = None) -> DataFrame:
    """intents(kind, symbol, account, ts, ...) with position, px and account values, as evaluate_risk() reads them.

    px is the usable price of the latest quote of the symbol that is at most ttl_s old.
    """
    priced = asof_quotes(intents, quotes, ttl_s)
    priced = priced.withColumn("px", usable_price(F.col("last"), F.col("bid"), F.col("ask"), F.col("close"))).drop("asof_ts", "bid", "ask", "last", "close", "volume")
    return account_for_intents(position_for_intents(priced, positions), accounts, order=order)


def session_start(rows: DataFrame, limits: RiskLimits = RiskLimits(), carried: DataFrame | None = None) -> DataFrame:
    """The first net value above zero that a run has seen, in order of seq, at an intent whose quantity was sound.

    carried(run_id, session_start), a row for each run, holds what runs have from before; it goes before that of rows.
    A run's first sound value is one minimum, combined before the shuffle, so a run of any length meets no single task.
    """
    q = F.col("quantity")
    sound = (q > 0) & ~gt(q, limits.max_order_quantity) & gt(F.col("net_liquidation"), 0.0)
    first = rows.filter(sound).groupBy(F.col("run_id").alias("_run")).agg(F.min(F.struct("seq", "net_liquidation")).alias("_first"))
    out = rows.join(first, F.col("run_id").eqNullSafe(F.col("_run")), "left")
    out = out.withColumn("session_start", F.when(F.col("seq") >= F.col("_first.seq"), F.col("_first.net_liquidation"))).drop("_run", "_first")
    if carried is None:
        return out
    before = carried.select(F.col("run_id").alias("_run"), F.col("session_start").alias("_start"))
    return out.join(before, F.col("run_id").eqNullSafe(F.col("_run")), "left").withColumn("session_start", F.coalesce("_start", "session_start")).drop("_run", "_start")


def drawdown_breaker(rows: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """rows with session_start and tripped: whether the run has lost more than it may by then."""
    out = session_start(rows, limits)
    return out.withColumn("tripped", F.coalesce(gt(F.col("session_start") - F.col("net_liquidation"), limits.max_daily_loss), F.lit(False)))


def evaluate_risk(rows: DataFrame, limits: RiskLimits = RiskLimits(), carried: DataFrame | None = None) -> DataFrame:
    """rows(run_id, seq, side, quantity, position, px, net_liquidation, gross_position_value, maint_margin_req) with reason.

    reason is the first rule an intent breaks, null if it may pass. Open loop: each intent is judged against the values
    given, so it equals a closed loop up to the first rejection of a run. carried is that of session_start(). A value that
    is not a number breaks no rule, and is no session start.
    """
    rows = session_start(rows, limits, carried)
    q, px, net, gross, maint = (F.col(c) for c in ("quantity", "px", "net_liquidation", "gross_position_value", "maint_margin_req"))
    resulting = F.col("position") + signed(F.col("side"), q)
    reason = first_error(
        (q <= 0, "quantity must be positive"),
        (gt(q, limits.max_order_quantity), "order quantity exceeds max_order_quantity"),
        ((resulting < 0) & F.lit(not limits.allow_short), "order would create a short position (allow_short=false)"),
        (gt(F.abs(resulting), limits.max_abs_position), "resulting position exceeds max_abs_position_per_symbol"),
        (px.isNull(), "no usable price"),
        (gt(gross + q * px, limits.max_notional), "max_notional_exposure exceeded"),
        (net.isNotNull() & gross.isNotNull() & (net <= 0), "Invalid NetLiquidation"),
        (gt(gross / F.nullif(net, F.lit(0.0)), limits.max_leverage), "max_leverage exceeded"),
        (net.isNotNull() & maint.isNotNull() & (net <= 0), "Invalid NetLiquidation"),
        (gt(maint / F.nullif(net, F.lit(0.0)), limits.max_margin_utilization), "max_margin_utilization exceeded"),
        (gt(F.col("session_start") - net, limits.max_daily_loss), "max_daily_loss exceeded (circuit breaker)"),
    )
    return rows.withColumn("reason", reason)


def classify_gate(intents: DataFrame, engine: bool = False) -> DataFrame:
    """intents with broker, live, dry_run, token_required, token, confirm -> gate: why sending is blocked, or `send`.

    The order manager asks for live mode, then for the token where it is required, then whether it is a dry run; the
    engine asks for dry run, live mode and always for the token. Only the real broker is gated by mode and token.
    """
    real = F.col("broker") == "ibkr"
    no_token, mismatch = F.coalesce(F.col("token"), F.lit("")) == "", ~F.col("confirm").eqNullSafe(F.col("token"))
    dry, not_live = (F.col("dry_run"), "dry_run"), (real & ~F.col("live"), "live_disabled")
    need = real if engine else real & F.col("token_required")
    tokens = [(need & no_token, "missing_order_token"), (need & mismatch, "confirm_token_mismatch")]
    rules = [dry, not_live, *tokens] if engine else [not_live, *tokens, dry]
    return intents.withColumn("gate", F.coalesce(first_error(*rules), F.lit("send")))
