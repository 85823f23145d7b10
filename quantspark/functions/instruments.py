"""Instruments: normal form, defaults and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_error

FIELDS = ("kind", "symbol", "exchange", "currency", "expiry")
KINDS = ("STK", "FUT", "FX")


def normal_field(name: str, c: Column) -> Column:
    """A field in its normal form."""
    if name in ("kind", "symbol"):
        return F.upper(c)
    return F.nullif(c if name == "expiry" else F.upper(c), F.lit(""))


def default_field(name: str, kind: Column, c: Column) -> Column:
    """A field of a normalized instrument, as its kind has it where it is missing or does not apply."""
    if name == "exchange":
        return F.when(kind == "STK", F.coalesce(c, F.lit("SMART"))).when(kind == "FX", F.coalesce(c, F.lit("IDEALPRO"))).otherwise(c)
    if name == "currency":
        return F.when(kind.isin("STK", "FUT"), F.coalesce(c, F.lit("USD"))).when(kind == "FX", F.lit(None)).otherwise(c)
    return F.when(kind.isin("STK", "FX"), F.lit(None)).otherwise(c) if name == "expiry" else c


def normalize_instrument(df: DataFrame) -> DataFrame:
    """Upper-cases kind, symbol, exchange and currency; empty exchange, currency and expiry become null. Nothing is trimmed."""
    return df.withColumns({c: normal_field(c, F.col(c)) for c in FIELDS})


def instrument_error(of: Callable[[str], Column] = F.col) -> Column:
    """The first rule that a normalized instrument breaks; the rules' order and texts are fixed. of gives its fields by name."""
    kind, blank = of("kind"), lambda c: F.coalesce(of(c), F.lit("")) == ""
    return first_error(
        (~F.coalesce(kind.isin(*KINDS), F.lit(False)), F.concat(F.lit("Unsupported instrument kind: "), F.coalesce(kind, F.lit("")))),
        (blank("symbol"), "Instrument symbol is required"),
        ((kind == "FUT") & blank("exchange"), "FUT exchange is required (e.g. CME)"),
        ((kind == "FUT") & ~F.coalesce(of("expiry").rlike(r"^\d{6}(\d{2})?$"), F.lit(False)), "FUT expiry must be YYYYMM or YYYYMMDD (e.g. 202503 or 20250315)"),
        ((kind == "FX") & ~of("symbol").rlike("^[A-Z]{6}$"), "FX symbol must be a 6-letter pair like EURUSD"),
    )


def validate_instrument(df: DataFrame, error: str = "error") -> DataFrame:
    """Normalized instruments with defaults by kind and an error column, null for sound rows."""
    df = normalize_instrument(df).withColumn(error, instrument_error())
    return df.withColumns({c: default_field(c, F.col("kind"), F.col(c)) for c in ("exchange", "currency", "expiry")})


def contract_to_instrument(df: DataFrame) -> DataFrame:
    """Vendor contracts (sec_type, symbol, exchange, currency, contract_month) as validated instruments."""
    sec, up = F.upper("sec_type"), lambda c: F.nullif(F.upper(c), F.lit(""))
    kind = F.when(sec == "CASH", "FX").otherwise(sec)
    raw = df.withColumns({
        "kind": kind, "symbol": F.when(sec == "CASH", F.concat(F.upper("symbol"), F.coalesce(F.upper("currency"), F.lit("")))).otherwise(F.upper("symbol")),
        "exchange": up("exchange"), "currency": up("currency"), "expiry": F.when(sec == "FUT", F.trim("contract_month")),
    })
    known = F.coalesce(sec.isin("STK", "FUT", "CASH"), F.lit(False))
    return validate_instrument(raw).withColumn("error", F.when(~known, F.concat(F.lit("Unsupported contract secType: "), F.coalesce(sec, F.lit("")))).otherwise(F.col("error")))


def apply_allowlist(df: DataFrame, kinds: list[str], symbols: list[str] = ()) -> DataFrame:
    """df with reason, null where kind and symbol are allowed; without symbols any symbol is. The lists are configuration."""
    clean = lambda xs: [x.strip().upper() for x in xs if x.strip()]
    kinds, symbols = clean(kinds), clean(symbols)
    rules = [(~F.coalesce(F.upper("kind").isin(*kinds), F.lit(False)), F.concat(F.lit("Instrument kind not allowed: "), F.col("kind")))]
    if symbols:
        rules.append((~F.coalesce(F.upper("symbol").isin(*symbols), F.lit(False)), F.concat(F.lit("Symbol not allowed: "), F.col("symbol"))))
    return df.withColumn("reason", first_error(*rules))
