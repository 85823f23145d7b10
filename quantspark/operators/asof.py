"""As-of joins without range explosion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tolerance_s: float | None = None, order: str | None = None, bucket_s: float = 86400.0) -> DataFrame:
    """left with right's values at the latest ts up to its own, null where there is none or it is older than tolerance_s.

    Both sides are put together and the last row of right is carried along: one shuffle, no pairs. Keys are cut into
    buckets of time, so a hot key spreads over many tasks. With a tolerance, a row of right also goes to the later buckets
    that it can reach, one at most unless the tolerance exceeds a bucket; without one, each bucket gets the last row of
    right before it, of which there is one for each key and bucket. order breaks ties of right's ts. Null keys match nothing.
    """
    right = right.dropna(subset=keys)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    struct = F.struct(F.col(ts).alias("_at"), *values)
    l = left.withColumns({"_value": F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType), "_side": F.lit(1), "_tie": F.lit(0).cast("long")})  # noqa: E741
    r = right.select(*keys, ts, struct.alias("_value"), F.lit(0).alias("_side"), (F.col(order) if order else F.lit(0)).cast("long").alias("_tie"))
    part: list[Column | str] = list(keys)
    bucket = F.floor(seconds(F.col(ts)) / bucket_s)
    l = l.withColumn("_bucket", bucket)  # noqa: E741
    part.append("_bucket")
    if tolerance_s is not None:
        r = r.withColumn("_bucket", F.explode(F.sequence(bucket, F.floor((seconds(F.col(ts)) + tolerance_s) / bucket_s))))
    else:
        r = r.withColumn("_bucket", bucket)
        last = r.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(ts, "_tie")).alias("_ends"))
        there = l.select(*keys, "_bucket").distinct().withColumn("_ends", F.lit(None).cast(last.schema["_ends"].dataType))
        each = last.unionByName(there).groupBy(*keys, "_bucket").agg(F.first("_ends", ignorenulls=True).alias("_ends"))
        before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        carried = each.withColumn("_value", F.last("_ends", ignorenulls=True).over(before)).filter("_value is not null")
        r = r.unionByName(carried.select(*keys, F.col("_value._at").alias(ts), "_value", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_tie"), "_bucket"))
    w = W.partitionBy(*part).orderBy(ts, "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = l.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    if tolerance_s is not None:
        fresh = seconds(F.col(ts)) - seconds(F.col("_last._at")) <= tolerance_s
        out = out.withColumn("_last", F.when(fresh, F.col("_last")))
    return out.select(*left.columns, F.col("_last._at").alias(f"asof_{ts}"), *[F.col(f"_last.{v}").alias(v) for v in values])


def asof_quotes(intents: DataFrame, quotes: DataFrame, ttl_s: float = 1.0) -> DataFrame:
    """The latest quote of each intent's symbol that is at most ttl_s old."""
    return asof(intents, quotes, ["symbol"], "ts", ["bid", "ask", "last", "close", "volume"], ttl_s)


def fill_missing_quotes(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """Quotes of which bid, ask, last and close are all null take last, close and volume from the latest bar before."""
    found = asof(quotes, bars.select("symbol", "ts", F.col("close").alias("bar_close"), F.col("volume").alias("bar_volume")), ["symbol"], "ts", ["bar_close", "bar_volume"])
    empty = F.coalesce("bid", "ask", "last", "close").isNull()
    return found.withColumns({
        "last": F.when(empty, F.col("bar_close")).otherwise(F.col("last")), "close": F.when(empty, F.col("bar_close")).otherwise(F.col("close")),
        "volume": F.when(empty, F.col("bar_volume")).otherwise(F.col("volume")),
    }).drop("asof_ts", "bar_close", "bar_volume")
