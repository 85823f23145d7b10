"""Quality issues of ordered bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspark.functions.compare import gt, lt

#: Bars of a symbol that one task orders.
BUCKET = 1 << 16


def _with_history(bars: DataFrame, bucket: int) -> DataFrame:
    """bars with _last, the last time before each bar, and _again, whether an earlier bar has its time (null times agree).

    A symbol's order is cut into buckets of bar_index. Each bucket gets the last time before it, of which there is one for
    each bucket; the first bar of each time is a minimum, combined before the shuffle. So no task orders a whole symbol.
    """
    rows = bars.withColumn("_bucket", F.floor(F.col("bar_index") / bucket))
    last = F.max_by("ts_epoch_s", F.when(F.col("ts_epoch_s").isNotNull(), F.col("bar_index")))
    earlier = W.partitionBy("_symbol").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy(F.col("symbol").alias("_symbol"), F.col("_bucket").alias("_at")).agg(last.alias("_end"))
    ends = ends.select("_symbol", "_at", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    first = bars.groupBy(F.col("symbol").alias("_of"), F.col("ts_epoch_s").alias("_ts")).agg(F.min("bar_index").alias("_first"))
    before = W.partitionBy("symbol", "_bucket").orderBy("bar_index").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(ends, F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    rows = rows.withColumn("_last", F.coalesce(F.last("ts_epoch_s", ignorenulls=True).over(before), "_carried"))
    rows = rows.join(first, F.col("symbol").eqNullSafe(F.col("_of")) & F.col("ts_epoch_s").eqNullSafe(F.col("_ts")))
    return rows.withColumn("_again", (F.col("bar_index") > F.col("_first")) & ~F.coalesce(F.isnan("ts_epoch_s"), F.lit(False)))


def _label() -> Column:
    return F.concat(F.lit("bar["), F.col("bar_index").cast("string"), F.lit("]"))


def _issue(level: str, code: str, text: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"))


def not_sorted() -> Column:
    return _issue("error", "not_sorted", F.concat(F.lit("timestamps not sorted at "), _label()))


def duplicate_timestamp() -> Column:
    return _issue("warn", "duplicate_timestamp", F.concat(F.lit("duplicate timestamp at "), _label()))


def row_issues() -> list[Column]:
    """Issues of a bar by itself, null where there is none: its time, prices, and their order, in which nothing holds of NaN."""
    timed, label = F.col("ts_epoch_s").isNotNull(), _label()
    found = [F.when(~timed, _issue("error", "missing_timestamp", F.concat(label, F.lit(" missing timestamp"))))]
    for c in ("open", "high", "low", "close"):
        value = F.col(c)
        found.append(F.when(timed & value.isNull(), _issue("error", f"missing_{c}", F.concat(label, F.lit(f" missing {c}")))))
        found.append(F.when(timed & (value <= 0), _issue("error", f"non_positive_{c}", F.concat(label, F.lit(f" non-positive {c}="), value.cast("string")))))
    low, high = F.col("low"), F.col("high")
    found.append(F.when(timed & gt(low, high), _issue("error", "low_above_high", F.concat(label, F.lit(" low > high")))))
    for c in ("open", "close"):
        unknown = (F.isnan(c) | F.isnan(low) | F.isnan(high)) & F.col(c).isNotNull() & low.isNotNull() & high.isNotNull()
        outside = (F.col(c) < low) | (F.col(c) > high) | unknown
        found.append(F.when(timed & outside, _issue("warn", f"{c}_outside", F.concat(label, F.lit(f" {c} outside [low,high]")))))
    return found


def validate_bars(bars: DataFrame, expected: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """bars(symbol, bar_index, ts_epoch_s, open, high, low, close) -> symbol, bar_index, level, code, message.

    bar_index is the input order, each once in a symbol. A bar without a time has that issue only; times are compared with the last time that
    is there; each later bar with a time that was seen is a duplicate, null times too, times that are not numbers never. A missing price yields its own
    issue and no comparison; one that is not a number lies outside of any range. Symbols of expected(symbol) without bars get `no bars`, with index -1.
    """
    rows = _with_history(bars, bucket)
    late = F.col("ts_epoch_s").isNotNull() & lt(F.col("ts_epoch_s"), F.col("_last"))
    found = [*row_issues(), F.when(late, not_sorted()), F.when(F.col("_again"), duplicate_timestamp())]
    out = rows.select("symbol", "bar_index", F.explode(F.array_compact(F.array(*found))).alias("i")).select("symbol", "bar_index", "i.*")
    if expected is not None:
        none = expected.join(bars.select("symbol").distinct(), "symbol", "left_anti")
        out = out.unionByName(none.select("symbol", F.lit(-1).cast("long").alias("bar_index"), F.lit("error").alias("level"), F.lit("no_bars").alias("code"), F.lit("no bars").alias("message")))
    return out


def validation_summary(issues: DataFrame) -> DataFrame:
    """For each symbol its issues by level, and whether an export of it fails."""
    count = lambda level: F.count_if(F.col("level") == level)
    return issues.groupBy("symbol").agg(count("error").alias("n_errors"), count("warn").alias("n_warnings"), F.bool_or(F.col("level") == "error").alias("failed"))
