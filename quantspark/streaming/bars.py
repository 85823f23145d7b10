"""Bars as streams: ingest, building from ticks, and risk evaluation by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quantspark.functions.compare import ge, gt, le
from quantspark.functions.quotes import usable_price
from quantspark.functions.text import first_error
from quantspark.operators.asof import asof
from quantspark.operators.risk import RiskLimits, account_for_intents, evaluate_risk
from quantspark.operators.scan import days, prefix_scan
from quantspark.operators.validate import duplicate_timestamp, not_sorted, row_issues
from quantspark.sources.audit import append_audit
from quantspark.sources.bars import build_bars
from quantspark.streaming.states import stream_order_issues


def stream_bars(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """bars(symbol, ts, open, high, low, close, ...): the first of each symbol and time, with the first rule it breaks.

    Duplicates are known for `delay`; the rules are those of a single bar, as order needs the whole history.
    """
    price = [F.col(c) for c in ("open", "high", "low", "close")]
    missing = price[0].isNull() | price[1].isNull() | price[2].isNull() | price[3].isNull()
    issue = first_error(
        (missing, "missing price"),
        (F.least(*price) <= 0, "non-positive price"),
        (gt(F.col("low"), F.col("high")), "low > high"),
        (~(ge(F.col("open"), F.col("low")) & le(F.col("open"), F.col("high"))), "open outside [low,high]"),
        (~(ge(F.col("close"), F.col("low")) & le(F.col("close"), F.col("high"))), "close outside [low,high]"),
    )
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"]).withColumn("issue", issue)


def stream_build_bars(ticks: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars of ticks, each once its end is `delay` behind the latest tick; ticks that come later are left out."""
    return build_bars(ticks.withWatermark("ts", delay), size)


def stream_validate_bars(bars: DataFrame, stretch_s: float = 86400.0) -> DataFrame:
    """bars(symbol, bar_index, ts_epoch_s, open, high, low, close) -> the issues that validate_bars() finds, over all batches.

    Batches follow each other in order of bar_index. Rules of a bar by itself need no state.
    """
    issues = lambda df, issue: df.select("symbol", "bar_index", issue.alias("i")).select("symbol", "bar_index", "i.*")
    own = issues(bars, F.explode(F.array_compact(F.array(*row_issues()))))
    order = stream_order_issues(bars, stretch_s)
    return own.unionByName(issues(order, F.when(F.col("code") == "not_sorted", not_sorted()).otherwise(duplicate_timestamp())))


def _judge(rows: DataFrame, path: str, batch_id: int, limits: RiskLimits, strategy: Column) -> None:
    """Judges the rows of a micro-batch, appends the decisions, and keeps the session starts that it finds beside them."""
    starts = f"{path}/session_starts_batches"
    carried = None
    if batch_id:
        known = rows.sparkSession.read.schema("run_id string, session_start double, batch long").parquet(starts)
        carried = known.filter(F.col("batch") < batch_id).groupBy("run_id").agg(F.min_by("session_start", "batch").alias("session_start"))
    judged = evaluate_risk(rows, limits, carried).persist()
    found = judged.groupBy(F.col("run_id").cast("string")).agg(F.max("session_start").alias("session_start")).filter("session_start is not null")
    if carried is not None:
        found = found.alias("f").join(carried.alias("c"), F.expr("f.run_id <=> c.run_id"), "left_anti")
    found.coalesce(1).write.mode("overwrite").parquet(f"{starts}/batch={batch_id}")
    out = judged.select("run_id", "seq", F.lit(None).cast("double").alias("ts_epoch_s"), strategy.alias("strategy"), F.to_json(F.struct("side", "quantity")).alias("intent_json"), F.col("reason").isNull().cast("int").alias("accepted"), "reason")
    append_audit(out, "decisions", path, batch_id)
    judged.unpersist()


def stream_evaluate(intents: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, limits: RiskLimits = RiskLimits()) -> StreamingQuery:
    """Judges the intents of each micro-batch and appends the decisions to the audit table at path.

    enrich adds position, price and account values. A batch that is run again replaces what it wrote. The session start of
    a run holds for all later batches; each batch keeps those it finds beside the decisions, in session_starts_batches.
    Batches follow each other as they come, and rows of a batch by seq.
    """
    each = lambda batch, k: _judge(enrich(batch), path, k, limits, F.lit("stream"))
    return intents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


QUOTE = "symbol string, ts timestamp, seq long, bid double, ask double, last double, close double, volume double"
ACCOUNT = "account string, ts timestamp, seq long, net_liquidation double, gross_position_value double, maint_margin_req double"
POSITION = "kind string, symbol string, ts timestamp, quantity double"
TICKS = "symbol string, ticks long"
#: Columns of a feed. `what` is intent, quote, account or position; each kind of row fills its own columns.
FEED = "what string, ts timestamp, seq long, run_id string, account string, kind string, symbol string, side string, quantity double, bid double, ask double, last double, close double, volume double, net_liquidation double, gross_position_value double, maint_margin_req double"


class _Known:
    """What earlier batches knew of each key, as a table that each batch writes anew; one that is run again reads and writes the same."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int):
        self.spark, self.path, self.batch_id = spark, path, batch_id

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.batch_id:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/known_{name}/batch={self.batch_id - 1}")

    def write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/known_{name}/batch={self.batch_id}")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that is last by ts and seq."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")).select(key, "r.*").dropna(subset=[key])


def stream_trade(feed: DataFrame, path: str, checkpoint: str, limits: RiskLimits = RiskLimits(), ttl_s: float = 1.0, every_n: int | None = None, quantity: float = 1.0) -> StreamingQuery:
    """Each trigger: signals from quotes, quotes, positions and accounts as of each intent, risk, and the audit table at path.

    feed has the columns of FEED, in order of ts over all batches. A quote is the price of its symbol for ttl_s, an account
    row holds until the account's next one, and position rows are changes that add up by kind and symbol. An intent sees
    what has its own time or an earlier one. With every_n, each n-th quote of a symbol is an intent of the quote's run_id,
    account and kind to buy, with the quote's seq, and counting goes on over batches.

    Joins are as-of joins of a batch's rows with what is known from before: one row for each symbol, account, and kind and
    symbol, which each batch writes anew below path. So a batch costs what it has and knows, not what there was.
    """

    def each(batch: DataFrame, k: int) -> None:
        batch = batch.persist()
        known = _Known(batch.sparkSession, path, k)
        own = lambda what, schema: batch.filter(F.col("what") == what).select(*StructType.fromDDL(schema).names)
        quotes = known.read("quotes", QUOTE).unionByName(own("quote", QUOTE)).persist()
        accounts = known.read("accounts", ACCOUNT).unionByName(own("account", ACCOUNT)).persist()
        moves = known.read("positions", POSITION).unionByName(own("position", POSITION)).persist()
        fields = ("run_id", "seq", "account", "kind", "symbol", "ts", "side", "quantity")
        intents = batch.filter("what = 'intent'").select(*fields, F.lit("feed").alias("strategy"))
        if every_n:
            seconds = F.unix_micros("ts") / 1e6
            before = known.read("ticks", TICKS)
            numbered = prefix_scan(batch.filter("what = 'quote' and symbol is not null"), ["symbol"], ["ts", "seq"], days(seconds), {"nth": ("sum", F.lit(1).cast("long"))})
            hits = numbered.join(before, "symbol", "left").filter((F.col("nth") + F.coalesce("ticks", F.lit(0))) % every_n == 0)
            signals = hits.withColumns({"side": F.lit("BUY"), "quantity": F.lit(float(quantity)), "strategy": F.lit("every_n")})
            intents = intents.unionByName(signals.select(*fields, "strategy"))
            counted = batch.filter("what = 'quote' and symbol is not null").groupBy("symbol").agg(F.count("*").alias("ticks"))
            known.write("ticks", before.unionByName(counted).groupBy("symbol").agg(F.sum("ticks").alias("ticks")))
        priced = asof(intents, quotes, ["symbol"], "ts", ["bid", "ask", "last", "close"], ttl_s, "seq")
        priced = priced.withColumn("px", usable_price(*(F.col(c) for c in ("last", "bid", "ask", "close")))).drop("asof_ts", "bid", "ask", "last", "close")
        steps = moves.groupBy("kind", "symbol", "ts").agg(F.sum("quantity").alias("moved"))
        held = prefix_scan(steps, ["kind", "symbol"], ["ts"], days(F.unix_micros("ts") / 1e6), {"position": ("sum", F.col("moved"))})
        placed = asof(priced, held, ["kind", "symbol"], "ts", ["position"]).drop("asof_ts").withColumn("position", F.coalesce("position", F.lit(0.0)))
        _judge(account_for_intents(placed, accounts, order="seq"), path, k, limits, F.col("strategy"))
        known.write("quotes", _newest(quotes, "symbol"))
        known.write("accounts", _newest(accounts, "account"))
        known.write("positions", moves.groupBy("kind", "symbol").agg(F.max("ts").alias("ts"), F.sum("quantity").alias("quantity")))
        for df in (quotes, accounts, moves, batch):
            df.unpersist()

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
