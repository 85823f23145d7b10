"""Orders: normal form, rules, and orders derived from intents and brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null, first_error

OPTIONAL = ("good_till_date", "account", "order_ref", "oca_group")


def normalize_orders(df: DataFrame) -> DataFrame:
    """Trims and upper-cases side, type and tif; optional texts are trimmed and null where blank."""
    required = {c: F.upper(F.trim(c)) for c in ("side", "order_type", "tif")}
    return df.withColumns({**required, **{c: blank_to_null(F.col(c)) for c in OPTIONAL if c in df.columns}})


def order_error(has_date: bool = True) -> Column:
    """The first rule that a normalized order breaks; order and texts are fixed. NaN breaks no comparison."""
    kind, quantity, limit, stop = (F.col(c) for c in ("order_type", "quantity", "limit_price", "stop_price"))
    low = lambda c: (c <= 0) & ~F.isnan(c)
    need_stop = lambda t: ((kind == t) & (stop.isNull() | low(stop)), f"stop_price is required and must be positive for {t} orders")
    date = F.col("good_till_date").isNull() if has_date else F.lit(True)
    return first_error(
        (~F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)), "side must be BUY or SELL"),
        (low(quantity), "quantity must be positive"),
        (~F.coalesce(kind.isin("MKT", "LMT", "STP", "STPLMT"), F.lit(False)), "order_type must be MKT, LMT, STP, or STPLMT"),
        ((kind == "LMT") & limit.isNull(), "limit_price is required for LMT orders"),
        ((kind == "LMT") & low(limit), "limit_price must be positive"),
        need_stop("STP"),
        need_stop("STPLMT"),
        ((kind == "STPLMT") & (limit.isNull() | low(limit)), "limit_price is required and must be positive for STPLMT orders"),
        (F.coalesce(F.col("tif"), F.lit("")) == "", "tif is required"),
        ((F.col("tif") == "GTD") & date, "good_till_date is required for GTD tif"),
    )


def validate_orders(df: DataFrame, error: str = "error") -> DataFrame:
    """Normalized orders with an error column, null for sound rows."""
    return normalize_orders(df).withColumn(error, order_error("good_till_date" in df.columns))


def intents_to_orders(intents: DataFrame) -> DataFrame:
    """Intents as order requests: missing order fields get their defaults."""
    missing = {"outside_rth": F.lit(False), "transmit": F.lit(True), **{c: F.lit(None).cast("string") for c in OPTIONAL}}
    return intents.withColumns({c: v for c, v in missing.items() if c not in intents.columns})


def expand_brackets(brackets: DataFrame) -> DataFrame:
    """bracket_id, side, quantity, entry_limit, take_profit, stop_loss -> three independent orders for each row.

    Rows with a price that is missing or not positive give none.
    """
    opposite = F.when(F.upper("side") == "BUY", "SELL").otherwise("BUY")
    leg = lambda name, side, kind, limit, stop: F.struct(F.lit(name).alias("leg"), side.alias("side"), F.lit(kind).alias("order_type"), limit.cast("double").alias("limit_price"), stop.cast("double").alias("stop_price"))
    none = F.lit(None)
    legs = F.array(
        leg("entry", F.upper("side"), "LMT", F.col("entry_limit"), none),
        leg("take_profit", opposite, "LMT", F.col("take_profit"), none),
        leg("stop_loss", opposite, "STP", none, F.col("stop_loss")),
    )
    sound = (F.col("entry_limit") > 0) & (F.col("take_profit") > 0) & (F.col("stop_loss") > 0)
    return brackets.filter(sound).select("bracket_id", "quantity", F.posexplode(legs).alias("leg_no", "order")).select("bracket_id", "leg_no", "quantity", "order.*")


def far_limit_price(side: Column, last: Column, close: Column) -> Column:
    """A limit that will not fill at once: half the price to buy (0.01 at least), one and a half to sell."""
    px = F.coalesce(last, close)
    return F.when(F.upper(side) == "BUY", F.greatest(F.lit(0.01), px * 0.5)).otherwise(px * 1.5)
