"""Cash, positions, average cost and equity from fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.operators.scan import BUCKET, blocks, prefix_scan

KEYS = ("run_id", "symbol")


def signed(side: Column, quantity: Column) -> Column:
    return F.when(F.upper(side) == "BUY", quantity).otherwise(-quantity)


def ledger_totals(fills: DataFrame, initial_cash: float = 100000.0) -> DataFrame:
    """fills(run_id, symbol, side, quantity, fill_price, commission) -> n_fills, cash, position for each run and symbol."""
    q = signed(F.col("side"), F.col("quantity"))
    return fills.groupBy(*KEYS).agg(F.count("*").alias("n_fills"), (F.lit(initial_cash) - F.sum(q * F.col("fill_price")) - F.sum("commission")).alias("cash"), F.sum(q).alias("position"))


def running_ledger(fills: DataFrame, initial_cash: float = 100000.0, bucket: int = BUCKET, levels: int = 2) -> DataFrame:
    """Cash and position after each fill, in order of bar_seq and order_key.

    A scan over fills of a bar (bucket order keys at a time), bars of a block and blocks, so a task holds no key's whole history.
    """
    q = signed(F.col("side"), F.col("quantity"))
    buckets = [[F.col("bar_seq"), F.floor(F.col("order_key") / bucket)], *blocks(F.col("bar_seq"), bucket, levels)]
    out = prefix_scan(fills, list(KEYS), ["bar_seq", "order_key"], buckets, {"_spent": ("sum", q * F.col("fill_price") + F.col("commission")), "position": ("sum", q)})
    return out.withColumn("cash", F.lit(initial_cash) - F.col("_spent")).select(*[c for c in fills.columns if c not in ("cash", "position")], "cash", "position")


#: Bars whose costs are composed at a time, order keys whose fills are folded at a time, and costs composed beyond.
BARS, ORDERS, FAN = 64, 1 << 12, 1 << 12


def average_cost(fills: DataFrame, bars: int = BARS, orders: int = ORDERS, fan: int = FAN) -> DataFrame:
    """run_id, symbol, position, avg_cost after all fills, in order of bar_seq and order_key.

    Fills that enlarge a position weigh into its cost; fills that reduce it, or turn it round, keep the cost, and a flat
    position has none. Once the position before some fills is known, the cost after them is slope * cost before + base,
    and such maps compose. Fills are folded by order keys of a bar; the maps are then composed by more order keys, by
    bars, by blocks of bars and by blocks of blocks, each a grouping of its own that holds `orders`, `bars` or `fan` maps.
    """
    fill = F.struct("order_key", signed(F.col("side"), F.col("quantity")).cast("double").alias("dq"), F.col("fill_price").cast("double").alias("px"))
    state = "struct<qty:double,slope:double,base:double>"

    def step(acc: Column, f: Column) -> Column:
        before, after = acc["qty"], acc["qty"] + f["dq"]
        enlarges = (before == 0) | (F.signum(before) == F.signum(f["dq"]))
        weighted = lambda part, own: F.when(after == 0, F.lit(0.0)).when(enlarges, (F.abs(before) * acc[part] + own) / F.abs(after)).otherwise(acc[part])
        return F.struct(after.alias("qty"), weighted("slope", F.lit(0.0)).alias("slope"), weighted("base", F.abs(f["dq"]) * f["px"]).alias("base")).cast(state)

    def compose(acc: Column, x: Column) -> Column:
        return F.struct(x["m"]["qty"].alias("qty"), (acc["slope"] * x["m"]["slope"]).alias("slope"), (x["m"]["slope"] * acc["base"] + x["m"]["base"]).alias("base")).cast(state)

    parts = fills.groupBy(*KEYS, "bar_seq", F.floor(F.col("order_key") / orders).alias("part")).agg(F.sort_array(F.collect_list(fill)).alias("fills"))
    parts = parts.withColumn("moved", F.aggregate("fills", F.lit(0.0), lambda q, f: q + f["dq"]))
    block = F.floor(F.col("bar_seq") / bars)
    parts = prefix_scan(parts, list(KEYS), ["bar_seq", "part"], [[F.col("bar_seq"), F.floor(F.col("part") / orders)], *blocks(block, fan)], {"held": ("sum", F.col("moved"))}, exclusive=True)
    start = lambda held: F.struct(held.alias("qty"), F.lit(1.0).alias("slope"), F.lit(0.0).alias("base")).cast(state)
    maps = parts.select(*KEYS, F.col("bar_seq").alias("at"), F.col("part").alias("nth"), F.aggregate("fills", start(F.coalesce("held", F.lit(0.0))), step).alias("m"))
    nothing = F.lit(0).cast("long")
    top = blocks(F.col("at"), fan, 2)
    for at, nth in ((F.col("at"), F.floor(F.col("nth") / orders)), (F.floor(F.col("at") / bars), nothing), (top[0][0], nothing), (blocks(F.col("at"), fan, 1)[0][0], nothing)):
        ordered = F.sort_array(F.collect_list(F.struct("at", "nth", "m")))
        maps = maps.groupBy(*KEYS, at.alias("to"), nth.alias("to_nth")).agg(ordered.alias("maps")).select(*KEYS, F.col("to").alias("at"), F.col("to_nth").alias("nth"), F.aggregate("maps", start(F.lit(0.0)), compose).alias("m"))
    return maps.select(*KEYS, F.col("m.qty").alias("position"), F.when(F.col("m.qty") != 0, F.col("m.base")).alias("avg_cost"))


def backtest_summary(totals: DataFrame, bars: DataFrame, initial_cash: float = 100000.0) -> DataFrame:
    """End equity (cash and the position at the last close) and return in percent, 0 where the start is 0."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "bar_seq").alias("last_close"))
    end = F.col("cash") + F.col("position") * F.col("last_close")
    start = F.lit(float(initial_cash))
    return totals.join(last, "symbol").select(*KEYS, start.alias("start_equity"), end.alias("end_equity"), F.when(start != 0, (end - start) / start * 100).otherwise(0.0).alias("return_pct"))


def equity_curve(fills: DataFrame, bars: DataFrame, initial_cash: float = 100000.0, bucket: int = BUCKET, levels: int = 2) -> DataFrame:
    """For each run, symbol and bar: account values after the fills of the bar, at its close.

    Fills are summed by bar first and then carried along the bars, so no bar meets more than one row, and a task holds a
    block of bars.
    """
    q = signed(F.col("side"), F.col("quantity"))
    steps = fills.groupBy(*KEYS, "bar_seq").agg(F.sum(q).alias("dq"), F.sum(q * F.col("fill_price") + F.col("commission")).alias("spent"))
    runs = fills.select(*KEYS).distinct()
    grid = runs.join(bars.select("symbol", "bar_seq", "ts", "close"), "symbol").join(steps, [*KEYS, "bar_seq"], "left")
    out = prefix_scan(grid, list(KEYS), ["bar_seq"], blocks(F.col("bar_seq"), bucket, levels), {"paid": ("sum", F.col("spent")), "position": ("sum", F.col("dq"))})
    out = out.withColumns({"cash": F.lit(initial_cash) - F.coalesce("paid", F.lit(0.0)), "position": F.coalesce("position", F.lit(0.0))})
    net = F.col("cash") + F.col("position") * F.col("close")
    return out.select(*KEYS, "bar_seq", "ts", "cash", "position", net.alias("net_liquidation"), F.abs(F.col("position") * F.col("close")).alias("gross_position_value"), net.alias("available_funds"), F.lit(0.0).alias("maint_margin_req"))


def net_positions(positions: DataFrame) -> DataFrame:
    """Quantity by kind and symbol over all accounts and exchanges."""
    return positions.groupBy("kind", "symbol").agg(F.sum("quantity").alias("quantity"))


def exposure_metrics(positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """positions(account, quantity, close), accounts(account, net_liquidation, maint_margin_req) -> gross value, leverage and margin use; null for net values of 0."""
    gross = positions.groupBy("account").agg(F.sum(F.abs(F.col("quantity")) * F.col("close")).alias("gross_position_value"))
    joined = accounts.join(gross, "account", "left").withColumn("gross_position_value", F.coalesce("gross_position_value", F.lit(0.0)))
    return joined.select("account", "gross_position_value", F.try_divide("gross_position_value", "net_liquidation").alias("leverage"), F.try_divide("maint_margin_req", "net_liquidation").alias("margin_utilization"))
