from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quantspark.functions.instruments import validate_instrument
from quantspark.functions.orders import expand_brackets, validate_orders
from quantspark.functions.text import clean_double, parse_epoch, strip_fences

#: The messages that these tests expect are fixed values.
INST = "kind string, symbol string, exchange string, currency string, expiry string"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("STK", "aapl", None, None, None), ("STK", "AAPL", "SMART", "USD", None, None)),
        (("FUT", "ES", None, None, "202503"), "FUT exchange is required (e.g. CME)"),
        (("FUT", "ES", "CME", None, None), "FUT expiry must be YYYYMM or YYYYMMDD (e.g. 202503 or 20250315)"),
        (("FUT", "ES", "CME", None, "BAD"), "FUT expiry must be YYYYMM or YYYYMMDD (e.g. 202503 or 20250315)"),
        (("FUT", "es", "cme", None, "202503"), ("FUT", "ES", "CME", "USD", "202503", None)),
        (("FX", "EUR/USD", None, None, None), "FX symbol must be a 6-letter pair like EURUSD"),
        (("FX", "eurusd", None, "usd", "x"), ("FX", "EURUSD", "IDEALPRO", None, None, None)),
        ((None, "A", None, None, None), "Unsupported instrument kind: "),
        (("STK", "", None, None, None), "Instrument symbol is required"),
    ],
)
def test_instruments(spark, row, want):
    got = validate_instrument(spark.createDataFrame([row], INST)).first()
    assert (got.error if isinstance(want, str) else tuple(got)) == want


ORDER = "side string, quantity double, order_type string, limit_price double, stop_price double, tif string, good_till_date string"


@pytest.mark.parametrize(
    ("row", "error"),
    [
        ((" buy ", 1.0, "mkt", None, None, "day", None), None),
        (("buy", 1.0, "LMT", None, None, "DAY", None), "limit_price is required for LMT orders"),
        (("buy", 1.0, "LMT", -1.0, None, "DAY", None), "limit_price must be positive"),
        (("buy", 1.0, "STP", None, None, "DAY", None), "stop_price is required and must be positive for STP orders"),
        (("buy", 1.0, "STP", None, 100.0, "DAY", None), None),
        (("buy", 1.0, "STPLMT", None, 100.0, "DAY", None), "limit_price is required and must be positive for STPLMT orders"),
        (("buy", 1.0, "STPLMT", 101.0, 100.0, "DAY", None), None),
        (("buy", 1.0, "LMT", 100.0, None, "gtd", " "), "good_till_date is required for GTD tif"),
        (("hold", 0.0, "X", None, None, "", None), "side must be BUY or SELL"),
        (("sell", 0.0, "X", None, None, "", None), "quantity must be positive"),
        (("sell", float("nan"), "MKT", None, None, " ", None), "tif is required"),
    ],
)
def test_orders(spark, row, error):
    assert validate_orders(spark.createDataFrame([row], ORDER)).first().error == error


def test_brackets(spark):
    rows = [(1, "BUY", 1.0, 100.0, 110.0, 95.0), (2, "SELL", 1.0, 100.0, 0.0, 95.0)]
    got = expand_brackets(spark.createDataFrame(rows, "bracket_id long, side string, quantity double, entry_limit double, take_profit double, stop_loss double")).orderBy("leg_no").collect()
    assert [(r.bracket_id, r.side, r.order_type, r.limit_price, r.stop_price) for r in got] == [(1, "BUY", "LMT", 100.0, None), (1, "SELL", "LMT", 110.0, None), (1, "SELL", "STP", None, 95.0)]


def test_text(spark):
    df = spark.createDataFrame([("20250101",), ("2025-01-01T00:00:00Z",), (" 1.5 ",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(parse_epoch(F.col("t"))).collect()] == [20250101.0, 1735689600.0, 1.5, None, None, None]
    df = spark.createDataFrame([("NaN",), ("2",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(clean_double(F.col("t"))).collect()] == [None, 2.0, None, None]
    df = spark.createDataFrame([("```json\n{}\n```",), (" a ",), ("```x```",)], "t string")
    assert [r[0] for r in df.select(strip_fences(F.col("t"))).collect()] == ["{}", "a", "```x```"]
