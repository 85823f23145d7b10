"""Open-loop backtests of many runs and symbols at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.quotes import apply_slippage
from quantspark.operators.fills import match_fills
from quantspark.operators.ledger import signed

#: Runs up to which their table is broadcast.
BROADCAST_RUNS = 65536

#: A strategy: bars in, intents out (symbol, order_key, submit_seq, side, quantity, order_type, limit_price, stop_price).
Signal = Callable[[DataFrame], DataFrame]


def every_n_signal(bars: DataFrame, n: int = 12, quantity: float = 1.0) -> DataFrame:
    """A market order to buy at each n-th tick of a symbol; the k-th tick (from 0) is filled on bar k."""
    hit = bars.filter((F.col("bar_seq") + 1) % n == 0)
    none = F.lit(None).cast("double")
    return hit.select("symbol", F.col("bar_seq").cast("long").alias("order_key"), F.col("bar_seq").alias("submit_seq"), F.lit("BUY").alias("side"), F.lit(quantity).alias("quantity"), F.lit("MKT").alias("order_type"), none.alias("limit_price"), none.alias("stop_price"))


INTENTS = "symbol string, order_key long, submit_seq long, side string, quantity double, order_type string, limit_price double, stop_price double"


def pandas_signal(strategy: Callable[[pd.DataFrame], pd.DataFrame], chunk: int | None = None, look_back: int = 0) -> Signal:
    """A strategy that only Python can express: it gets the bars of one symbol in order and returns its intents.

    With chunk, it gets so many bars of a symbol at a time, on a task of their own, after the look_back bars before them.
    Then what it decides on a bar may depend on that bar and the look_back bars before only, order_key has to be the
    bar_seq of the bar that it decides on, and the result is that of all bars at once. bar_seq numbers bars without gaps.
    """
    ordered = lambda bars: bars.sort_values("bar_seq", ignore_index=True)
    if chunk is None:
        return lambda bars: bars.groupBy("symbol").applyInPandas(lambda own: strategy(ordered(own)), INTENTS)

    def decide(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = strategy(ordered(own.drop(columns="_chunk")))
        return out[out["order_key"] // chunk == key[1]]

    def signal(bars: DataFrame) -> DataFrame:
        at = F.floor(F.col("bar_seq") / chunk)
        chunks = F.sequence(at, F.floor((F.col("bar_seq") + look_back) / chunk))
        return bars.withColumn("_chunk", F.explode(chunks)).groupBy("symbol", "_chunk").applyInPandas(decide, INTENTS)

    return signal


def run_backtests(bars: DataFrame, signal: Signal, runs: DataFrame | list[tuple[str, float, float]], initial_cash: float = 100000.0) -> DataFrame:
    """Summary of each run and symbol: start and end equity and the return in percent, 0 where the start is 0.

    runs is a table (run_id, initial_cash, slippage_bps, commission), of which missing columns are 100,000 and 0, or a list
    of (run_id, slippage in basis points, commission for each fill) with one initial cash. A spread moves quotes and no
    fill, so it is a parameter of quotes_from_bars() alone.

    Signals are matched with bars once. What a run gets is linear in what was bought, sold and filled, so fills are summed
    by symbol, and the runs are put to these sums: a row for each run and symbol, as in the result, and none for each fill.
    """
    if isinstance(runs, list):
        runs = bars.sparkSession.createDataFrame([(r, float(initial_cash), float(bps), float(fee)) for r, bps, fee in runs], "run_id string, initial_cash double, slippage_bps double, commission double")
    default = {"initial_cash": initial_cash, "slippage_bps": 0.0, "commission": 0.0}
    runs = runs.select("run_id", *[F.coalesce(F.col(c).cast("double"), F.lit(v)).alias(c) if c in runs.columns else F.lit(v).alias(c) for c, v in default.items()])
    buy, paid = F.upper("side") == "BUY", F.col("quantity") * F.col("price")
    q = signed(F.col("side"), F.col("quantity"))
    sums = match_fills(signal(bars), bars).groupBy("symbol").agg(F.sum(F.when(buy, paid).otherwise(0.0)).alias("bought"), F.sum(F.when(buy, 0.0).otherwise(paid)).alias("sold"), F.count("*").alias("n"), F.sum(q).alias("position"))
    last = bars.groupBy("symbol").agg(F.max_by("close", "bar_seq").alias("last_close"))
    by_symbol = sums.join(last, "symbol")
    each = by_symbol.crossJoin(F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs)
    at_cost = apply_slippage(F.lit(1.0), F.lit("BUY"), F.col("slippage_bps")), apply_slippage(F.lit(1.0), F.lit("SELL"), F.col("slippage_bps"))
    start = F.col("initial_cash")
    end = start - F.col("bought") * at_cost[0] + F.col("sold") * at_cost[1] - F.col("n") * F.col("commission") + F.col("position") * F.col("last_close")
    return each.select("run_id", "symbol", start.alias("start_equity"), end.alias("end_equity"), F.when(start != 0, (end - start) / start * 100).otherwise(0.0).alias("return_pct"))
