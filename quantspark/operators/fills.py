"""Matching of orders with bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.compare import ge, le, number
from quantspark.functions.quotes import apply_slippage
from quantspark.operators.scan import BUCKET, blocks, prefix_scan
from quantspark.sources.shared import written

#: Bars, or blocks of them, that a block of the next level summarises.
BLOCK = 32
#: Waiting orders that one task holds, as it remembers the least node of each.
WAITING = 1 << 16


def align_ticks(bars: DataFrame) -> DataFrame:
    """A tick for each bar: which bar the strategy sees and which one orders of that tick are first held against."""
    return bars.withColumnsRenamed({"bar_seq": "tick"}).withColumn("visible_seq", F.greatest(F.col("tick") - 1, F.lit(0).cast("long"))).withColumn("fillable_seq", F.col("tick"))


def history_features(bars: DataFrame, n: int = 20, bucket: int = BUCKET, levels: int = 2) -> DataFrame:
    """What is known before each bar, from earlier bars only: how many, their highest and lowest price, the mean of the last n closes.

    bar_seq numbers a symbol's bars without gaps. Blocks of bars are apart; each also gets the n bars before it, for the mean.
    """
    block = F.floor(F.col("bar_seq") / bucket)
    rows = bars.select("symbol", "bar_seq", "high", "low", "close", block.alias("_own"))
    rows = rows.withColumn("_block", F.explode(F.sequence("_own", F.floor((F.col("bar_seq") + n) / bucket))))
    own = F.col("_own") == F.col("_block")
    values = {"n_seen": ("sum", F.when(own, F.lit(1).cast("long"))), "high_seen": ("max", F.when(own, F.col("high"))), "low_seen": ("min", F.when(own, F.col("low")))}
    mean = {"mean_close": lambda w: F.avg("close").over(w.rowsBetween(-n, -1))}
    upper = blocks(F.col("_block") * bucket, bucket, levels)[1:] if levels > 1 else []
    out = prefix_scan(rows, ["symbol"], ["bar_seq"], [[F.col("_block")], *upper], values, True, mean).filter(own)
    return out.select("symbol", "bar_seq", F.coalesce("n_seen", F.lit(0).cast("long")).alias("n_seen"), "high_seen", "low_seen", "mean_close")


def _fits(kind: Column, buy: Column, limit: Column, stop: Column, low: Column, high: Column) -> Column:
    """Whether a bar, or any bar of a block by its extremes, may fill the order."""
    by_limit = F.when(buy, le(low, limit)).otherwise(ge(high, limit))
    by_stop = F.when(buy, ge(high, stop)).otherwise(le(low, stop))
    return F.when(kind == "MKT", F.lit(True)).when(kind == "LMT", by_limit).when(kind == "STP", by_stop).when(kind == "STPLMT", by_limit & by_stop).otherwise(F.lit(False))


def match_fills(orders: DataFrame, bars: DataFrame, slippage_bps: float = 0.0, commission: float = 0.0, block: int = BLOCK) -> DataFrame:
    """orders(order_key, symbol, side, quantity, order_type, limit_price, stop_price, submit_seq, ...) -> their fills.

    An order fills whole on the first bar from submit_seq on that touches it: market orders at the open, limit and
    stop-limit orders at the limit, stop orders at the stop, before slippage. A stop-limit order needs both conditions
    in one bar. Orders that no bar touches have no row. Prices that are not numbers touch nothing.

    Market orders are an equi-join. For others, blocks of bars, of blocks and so on hold the lowest low and the highest
    high. An order is held against what follows it within its own block, then within the block above and so on, and
    then goes down to the bar, so it meets `block` entries a level and way, however long it waits and however many bars
    there are. For limit and stop orders the first block that fits holds the fill; for stop-limit orders the test is
    necessary only, and all blocks that fit are followed. Orders and bars are written once, as every level reads them.
    Waiting orders are parted by their number, not by their bytes, so a task's memory does not grow with the table. What
    they touch first is written too: both sides of that join are then parted alike, whatever the levels' plans become.
    """
    kind = F.col("order_type")
    cols = orders.columns
    orders = written(orders, "orders")
    bars = written(bars.select("symbol", "bar_seq", F.col("ts").alias("fill_ts"), "open", "high", "low"), "bars")
    at_open = bars.select("symbol", F.col("bar_seq").alias("submit_seq"), "fill_ts", F.col("open").alias("price"))
    filled = orders.filter(kind == "MKT").join(at_open, ["symbol", "submit_seq"]).select(*cols, F.col("submit_seq").alias("bar_seq"), "fill_ts", "price")
    waiting = orders.filter(kind != "MKT")
    n = waiting.count()
    if n:
        parts = max(-(-n // WAITING), orders.sparkSession.sparkContext.defaultParallelism)
        waiting = waiting.repartition(parts, "order_key")
        price = F.when(kind == "STP", F.col("stop_price")).otherwise(F.col("limit_price"))
        first = written(_first_touch(waiting, bars, block), "touches").repartition(parts, "order_key")
        touched = waiting.join(first, "order_key").join(bars.select("symbol", "bar_seq", "fill_ts"), ["symbol", "bar_seq"])
        filled = filled.unionByName(touched.select(*cols, "bar_seq", "fill_ts", price.alias("price")))
    return filled.withColumn("fill_price", apply_slippage(F.col("price"), F.col("side"), F.lit(float(slippage_bps)))).withColumn("commission", F.lit(float(commission)))


#: Parts that the orders of one block are dealt to, each with the block's entries, on the top level and below it: the higher, the more orders ask for one block.
SALTS = (64, 16, 1)


def _first_touch(waiting: DataFrame, bars: DataFrame, block: int) -> DataFrame:
    """order_key, bar_seq: the first bar from submit_seq on that touches the order. There are as many levels as the longest history needs."""
    longest = bars.agg(F.max("bar_seq")).first()[0] or 0
    top = 0
    while block ** (top + 1) <= longest:
        top += 1
    salt_of = lambda k: SALTS[min(top - k, len(SALTS) - 1)] if k else 1
    above = lambda c, k: F.floor(c / block) if k < top else F.lit(0).cast("long")
    own = ["order_key", "symbol", "order_type", "buy", "limit_price", "stop_price"]
    fits = _fits(F.col("order_type"), F.col("buy"), F.col("limit_price"), F.col("stop_price"), F.col("low"), F.col("high"))
    asked = waiting.withColumn("buy", F.upper("side") == "BUY").select(*own, "submit_seq")
    salted = lambda df, k: df.withColumn("salt", F.pmod(F.xxhash64("order_key"), F.lit(salt_of(k))))
    # where a block that fits holds the fill, only the first one is followed
    follow = lambda df: df.groupBy(*own, F.when(F.col("order_type") == "STPLMT", F.col("node")).alias("which")).agg(F.min("node").alias("node")).drop("which")
    levels = [bars.select("symbol", F.col("bar_seq").alias("node"), number(F.col("low")).alias("low"), number(F.col("high")).alias("high"))]
    for _ in range(top):
        levels.append(levels[-1].groupBy("symbol", F.floor(F.col("node") / block).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high")))
    met = found = None
    for k in range(top, -1, -1):
        here = levels[k].withColumns({"above": above(F.col("node"), k), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt_of(k) - 1).cast("long")))})
        at = F.floor(F.col("submit_seq") / block**k)
        later = F.col("node") >= F.col("at") if k == 0 else F.col("node") > F.col("at")
        found = salted(asked.select(*own, at.alias("at"), above(at, k).alias("above")), k).join(here, ["symbol", "above", "salt"]).filter(later & fits).select(*own, "node")
        if met is not None:
            below = salted(met.withColumnRenamed("node", "above"), k).join(here, ["symbol", "above", "salt"]).filter(fits).select(*own, "node")
            found = found.unionByName(below)
        if k:
            met = follow(found)
    return found.groupBy("order_key").agg(F.min("node").alias("bar_seq"))  # a bar that fits is a fill, so the first one is
