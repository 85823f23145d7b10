"""Decision logs and tool calls held as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.compare import gt
from quantspark.functions.instruments import FIELDS, default_field, instrument_error, normal_field
from quantspark.functions.text import audit_json, blank_to_null, first_error, strip_fences

#: Scalars are read as text and cast afterwards, so that one odd item does not void its array.
_INSTRUMENT = "struct<kind:string,symbol:string,exchange:string,currency:string,expiry:string>"
_ORDER = "instrument string, side string, qty string, type string, limit_price string, stop_price string, tif string"
_ITEM = "action string, order_id string, reason string, order string"


def _is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))


#: Fields that an order of a decision has, and what a decision has besides.
_TERMS = ("side", "quantity", "order_type", "limit_price", "stop_price", "tif")


def _decision(item: Column) -> Column:
    """An item of a decision list as a struct, with the first rule that it breaks as `error`."""

    def read(i: Column) -> Column:
        return F.transform(F.array(F.from_json(i["order"], _ORDER)), lambda o: F.struct(i.alias("i"), o.alias("o"), F.from_json(o["instrument"], _INSTRUMENT).alias("n")))[0]

    upper = lambda c, default: F.upper(F.trim(F.coalesce(c, F.lit(default))))

    def flat(r: Column) -> Column:
        i, o, n = r["i"], r["o"], r["n"]
        return F.struct(
            upper(i["action"], "").alias("action"), blank_to_null(i["order_id"]).alias("order_id"), i["reason"].alias("reason"), _is_object(item).alias("is_object"), _is_object(i["order"]).alias("has_order"), _is_object(o["instrument"]).alias("has_instrument"),
            *[normal_field(c, F.trim(n[c])).alias(c) for c in FIELDS], upper(o["side"], "BUY").alias("side"), F.coalesce(o["qty"].try_cast("double"), F.when(o["qty"].isNull(), 0.0)).alias("quantity"),
            upper(o["type"], "MKT").alias("order_type"), o["limit_price"].try_cast("double").alias("limit_price"), o["stop_price"].try_cast("double").alias("stop_price"), upper(o["tif"], "DAY").alias("tif"),
        )

    def judged(x: Column) -> Column:
        order, wrong = x["action"].isin("PLACE", "MODIFY"), instrument_error(lambda c: x[c])
        error = first_error(
            (~x["is_object"], "Each decision must be an object"),
            (~x["action"].isin("PLACE", "MODIFY", "CANCEL"), F.concat(F.lit("Unsupported action: "), x["action"])),
            (x["action"].isin("MODIFY", "CANCEL") & x["order_id"].isNull(), F.concat(x["action"], F.lit(" requires order_id"))),
            (order & ~x["has_order"], "order must be an object"),
            (order & ~x["has_instrument"], "order.instrument must be an object"),
            (order & wrong.isNotNull(), wrong),
            (order & x["quantity"].isNull(), "qty must be a number"),
        )
        kept = [F.when(order, default_field(c, x["kind"], x[c]) if c in FIELDS else x[c]).alias(c) for c in (*FIELDS, *_TERMS)]
        return F.struct(x["action"].alias("action"), x["order_id"].alias("order_id"), x["reason"].alias("reason"), *kept, error.alias("error"))

    # each step is bound to a variable of its own, so that nothing is parsed twice
    bound = lambda c, f: F.transform(F.array(c), f)[0]
    return bound(bound(bound(F.from_json(item, _ITEM), read), flat), judged)


def _responses(responses: DataFrame) -> DataFrame:
    """resp_id, decisions (an array, null where there is no list) and response_error; each response by itself, on one read and without a shuffle."""
    parsed = responses.select("resp_id", strip_fences(F.col("raw")).alias("text"))
    parsed = parsed.select("resp_id", "text", F.try_parse_json("text").isNotNull().alias("valid"), F.from_json("text", "decisions array<string>")["decisions"].alias("items"))
    whole = first_error(
        (~F.col("valid"), "LLM output is not valid JSON"),
        (~_is_object(F.col("text")), "LLM output must be a JSON object"),
        (F.col("items").isNull(), "LLM output must contain 'decisions' list"),
    )
    parsed = parsed.select("resp_id", whole.alias("whole"), F.when(F.col("valid") & _is_object(F.col("text")), F.transform("items", _decision)).alias("decisions"))
    first = F.get(F.filter(F.transform("decisions", lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0))
    return parsed.select("resp_id", "decisions", F.coalesce("whole", first).alias("response_error"))


def parse_decisions(responses: DataFrame) -> DataFrame:
    """responses(resp_id, raw) -> one row for each decision, with response_error, null where the whole response is sound.

    A response that is not a JSON object with a list of decisions, or whose list is empty, gives one row with decision_no
    null. Any bad item rejects the whole response; its error is that of the first bad item. The order itself is not
    rule-checked here. A response is one row, so no row is shuffled.
    """
    out = _responses(responses).select("resp_id", "response_error", F.when(F.col("decisions").isNotNull(), F.size("decisions")).alias("n_decisions"), F.posexplode_outer("decisions").alias("decision_no", "x"))
    return out.select("resp_id", "n_decisions", "decision_no", *[F.col("x")[c].alias(c) for c in ("action", "order_id", "reason", *FIELDS, *_TERMS)], "response_error")


def _broken_limit(of: Callable[[str], Column], kinds: list[str], symbols: list[str], max_quantity: float) -> Column:
    """The first limit that a decision breaks, null where none; cancellations break none."""
    up = lambda xs: [x.strip().upper() for x in xs]
    return F.when(of("action") != "CANCEL", first_error(
        (~F.upper(of("kind")).isin(*up(kinds)), F.concat(F.lit("Instrument kind not allowed: "), of("kind"))),
        ((~F.upper(of("symbol")).isin(*up(symbols))) if symbols else F.lit(False), F.concat(F.lit("Symbol not allowed: "), of("symbol"))),
        (gt(of("quantity"), max_quantity), F.concat(F.lit("Quantity too large: "), of("quantity").cast("string"), F.lit(f" > {float(max_quantity)}"))),
    ))


def _verdict(n: Column, broken: Column, max_orders: int) -> Column:
    return first_error(
        (F.lit(max_orders <= 0), "max_orders must be positive"),
        (n > max_orders, F.concat(F.lit("LLM produced too many decisions: "), n.cast("string"), F.lit(f" > {max_orders}"))),
        (broken.isNotNull(), broken),
    )


def limit_responses(responses: DataFrame, kinds: list[str], symbols: list[str], max_orders: int, max_quantity: float) -> DataFrame:
    """enforce_limits() of parse_decisions(), for responses(resp_id, raw): judged row by row, without taking them apart."""
    broken = F.transform("decisions", lambda x: _broken_limit(lambda c: x[c], kinds, symbols, max_quantity))
    n, first = F.size("decisions").cast("long"), F.get(F.filter("broken", lambda e: e.isNotNull()), F.lit(0))
    judged = _responses(responses).select("resp_id", "response_error", n.alias("n_decisions"), broken.alias("broken"))
    # a filter does not go below explode(), so responses are parsed for it once and not twice
    rows = judged.select(F.explode(F.array(F.struct("resp_id", "n_decisions", _verdict(F.col("n_decisions"), first, max_orders).alias("verdict"), "response_error"))).alias("r"))
    return rows.filter("r.response_error is null").select("r.resp_id", "r.n_decisions", "r.verdict")


def enforce_limits(decisions: DataFrame, kinds: list[str], symbols: list[str], max_orders: int, max_quantity: float) -> DataFrame:
    """Sound decisions by response -> resp_id, n_decisions, verdict: null where allowed, else the first limit that is broken."""
    broken = _broken_limit(F.col, kinds, symbols, max_quantity)
    per = decisions.filter("response_error is null").withColumn("_e", broken).groupBy("resp_id").agg(F.max("n_decisions").alias("n_decisions"), F.min(F.when(F.col("_e").isNotNull(), F.struct("decision_no", "_e"))).alias("_first"))
    return per.select("resp_id", F.col("n_decisions").cast("long").alias("n_decisions"), _verdict(F.col("n_decisions"), F.col("_first._e"), max_orders).alias("verdict"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(reply_id, raw) -> reply_id, message, call_no, call_id, name, args: a row for each tool call, one with nulls without any.

    A text that is not a JSON object is the message as a whole. Calls without a name go; args that are no object are {}.
    """
    text = strip_fences(F.coalesce(F.col("raw"), F.lit("")))
    parsed = replies.withColumn("_text", text).withColumn("_o", F.when(_is_object(F.col("_text")) & F.try_parse_json("_text").isNotNull(), F.from_json("_text", "assistant_message string, tool_calls array<string>")))
    call = lambda x: F.from_json(x, "id string, name string, args string")
    calls = F.transform(F.filter(F.coalesce(F.col("_o.tool_calls"), F.array().cast("array<string>")), _is_object), call)
    named = F.filter(calls, lambda c: blank_to_null(c["name"]).isNotNull())
    message = F.when(F.col("_o").isNull(), F.coalesce("raw", F.lit(""))).otherwise(F.coalesce("_o.assistant_message", F.lit("")))
    out = parsed.select("reply_id", message.alias("message"), F.posexplode_outer(named).alias("call_no", "c"))
    args = F.when(F.col("c").isNotNull(), F.when(_is_object(F.col("c.args")), F.col("c.args")).otherwise("{}"))
    return out.select("reply_id", "message", "call_no", F.col("c.id").alias("call_id"), F.trim("c.name").alias("name"), args.alias("args"))


def extract_tool_calls(contents: DataFrame) -> DataFrame:
    """contents(content_id, content), JSON with parts[] -> content_id, text (all text parts in order), call_no, name, args."""
    parts = F.transform(F.coalesce(F.from_json("content", "parts array<string>")["parts"], F.array().cast("array<string>")), lambda p: F.from_json(p, "text string, functionCall string"))
    named = F.filter(F.transform(parts, lambda p: F.from_json(p["functionCall"], "name string, args string")), lambda c: blank_to_null(c["name"]).isNotNull())
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")
    out = contents.select("content_id", text.alias("text"), F.posexplode_outer(named).alias("call_no", "c"))
    args = F.when(F.col("c").isNotNull(), F.when(_is_object(F.col("c.args")), F.col("c.args")).otherwise("{}"))
    return out.select("content_id", "text", "call_no", F.trim("c.name").alias("name"), args.alias("args"))


def tool_result_json(call_id: Column, name: Column, ok: Column, result: Column) -> Column:
    return F.to_json(F.struct(F.struct(call_id.alias("id"), name.alias("name"), ok.alias("ok"), result.alias("result")).alias("tool_result")), {"ignoreNullFields": "false"})


def account_map(rows: DataFrame) -> DataFrame:
    """rows(account, tag, value text, seq) -> account, values: the last number of each tag; blank tags and texts that are no number go."""
    number = F.col("value").try_cast("double")
    kept = rows.withColumn("_v", number).filter(F.col("_v").isNotNull() & (F.trim(F.coalesce("tag", F.lit(""))) != ""))
    last = kept.groupBy("account", F.trim("tag").alias("tag")).agg(F.max_by("_v", "seq").alias("v"))
    return last.groupBy("account").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "v")))).alias("values"))


def build_context_docs(accounts: DataFrame, positions: DataFrame, open_orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """One JSON document for each tick: account values, positions, open orders and quotes by symbol, with quote errors in place.

    accounts(tick, values), positions(tick, symbol, kind, qty, avg_cost), open_orders(tick, order_id, status, filled,
    remaining), quotes(tick, symbol, bid, ask, last, error). Lists are in order of their first field.
    """
    gather = lambda df, cols, name: df.groupBy("tick").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    p = gather(positions, ["symbol", "kind", "qty", "avg_cost"], "positions")
    o = gather(open_orders, ["order_id", "status", "filled", "remaining"], "open_orders")
    q = quotes.groupBy("tick").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", F.struct("ask", "bid", "error", "last").alias("quote"))))).alias("market_snapshots"))
    joined = accounts.join(p, "tick", "left").join(o, "tick", "left").join(q, "tick", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType))
    doc = audit_json({"account": F.col("values"), "positions": empty("positions"), "open_orders": empty("open_orders"), "market_snapshots": F.col("market_snapshots")})
    return joined.select("tick", doc.alias("context_json"))
