"""Quotes and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_error


def usable_price(last: Column, bid: Column, ask: Column, close: Column) -> Column:
    """The first that is above zero: last, the middle of bid and ask (both above zero), close; else null."""
    good = lambda c: (c > 0) & ~F.isnan(c)
    return F.coalesce(F.when(good(last), last), F.when(good(bid) & good(ask), (bid + ask) / 2), F.when(good(close), close))


def quote_error() -> Column:
    below = lambda c: (F.col(c) < 0) & ~F.isnan(c)
    return first_error(
        (below("bid"), "Invalid bid in snapshot"),
        (below("ask"), "Invalid ask in snapshot"),
        ((F.col("bid") > F.col("ask")) & ~F.isnan("bid"), "Invalid snapshot (bid > ask)"),
        (below("last") | below("close"), "Invalid price in snapshot"),
    )


def validate_quotes(df: DataFrame, error: str = "error") -> DataFrame:
    return df.withColumn(error, quote_error())


def apply_slippage(price: Column, side: Column, bps: Column) -> Column:
    """Buys pay bps basis points more and others get as much less; no change for bps of zero or less."""
    move = bps / 10000.0
    return F.when(bps <= 0, price).when(F.upper(side) == "BUY", price * (1 + move)).otherwise(price * (1 - move))


def quotes_from_bars(bars: DataFrame, spread: float = 0.0) -> DataFrame:
    """A quote at each bar: last is the close, bid and ask lie half a spread around it, null without a spread."""
    half = lambda sign: (F.col("close") + sign * spread / 2) if spread else F.lit(None).cast("double")
    return bars.select("symbol", "ts", half(-1).alias("bid"), half(1).alias("ask"), F.col("close").alias("last"), F.col("close"), "volume")
