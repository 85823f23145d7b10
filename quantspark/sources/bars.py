"""OHLCV bars: reading, writing, merging and building."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantspark.functions.text import clean_double, parse_duration, parse_end, parse_epoch
from quantspark.operators.scan import days, prefix_scan
from quantspark.schemas import BARS_CSV, REQUIRED_BAR_COLUMNS


def require_columns(columns: list[str], required: tuple[str, ...] = REQUIRED_BAR_COLUMNS) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars from CSV files with a header, all text first and cast where it parses; extra columns are ignored.

    The symbol is the argument or the folder symbol=... that a file lies in. Empty, null and None volumes are null.
    ingest_seq tells rows apart; bar_seq numbers each symbol's bars by time, ties by file, then in the file's order, however
    files are split among tasks.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    require_columns(raw.columns)
    volume = F.col("volume") if "volume" in raw.columns else F.lit(None).cast("string")
    volume = F.when(~F.lower(F.trim(volume)).isin("", "null", "none"), volume).try_cast("double")
    rows = raw.select(
        (F.lit(symbol) if symbol else F.col("symbol")).alias("symbol"), parse_epoch(F.col("timestamp")).alias("ts_epoch_s"),
        *[F.col(c).try_cast("double").alias(c) for c in REQUIRED_BAR_COLUMNS[1:]], volume.alias("volume"), F.monotonically_increasing_id().alias("ingest_seq"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
    )
    return _numbered(rows, F.col("ts_epoch_s"), ["ts_epoch_s", "_file", "_start", "ingest_seq"]).drop("_file", "_start")


def _numbered(rows: DataFrame, seconds: Column, order: list[str]) -> DataFrame:
    """rows with bar_seq: 0, 1, ... for each symbol in the order, which begins with the time of `seconds`; null times come first.

    Rows of a day are numbered on one task, and the days' counts run along them.
    """
    out = prefix_scan(rows, ["symbol"], order, days(seconds), {"bar_seq": ("sum", F.lit(1).cast("long"))})
    return out.withColumn("bar_seq", F.col("bar_seq") - 1)


def write_bars(bars: DataFrame, path: str, partitions: int | None = None) -> None:
    """CSV files by symbol, sorted by time; timestamps as whole seconds and null volumes as empty fields."""
    n = partitions or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bars.select("symbol", F.floor("ts_epoch_s").cast("long").alias("timestamp"), *BARS_CSV[1:])
    rows.repartitionByRange(n, "symbol", "timestamp").sortWithinPartitions("symbol", "timestamp").write.partitionBy("symbol").option("header", True).mode("overwrite").csv(path)


def merge_backfill(pages: DataFrame) -> DataFrame:
    """pages(symbol, ts, page_no, ingest_seq, ...): of bars at one time the first seen stays.

    A minimum that is combined before the shuffle, so overlaps of any size cost one row for each task.
    """
    rest = [c for c in pages.columns if c not in ("symbol", "ts")]
    first = F.min_by(F.struct(*rest), F.struct("page_no", "ingest_seq")).alias("bar")
    return pages.groupBy("symbol", "ts").agg(first).select("symbol", "ts", "bar.*")


def build_bars(ticks: DataFrame, size: str = "1 hour") -> DataFrame:
    """ticks(symbol, ts, event_id, px) -> symbol, ts, open, high, low, close, volume (ticks in the bar)."""
    seq = F.struct("ts", "event_id")
    out = ticks.groupBy("symbol", F.window("ts", size).alias("w")).agg(
        F.min_by("px", seq).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", seq).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def number_bars(bars: DataFrame) -> DataFrame:
    """bar_seq: 0, 1, ... for each symbol by time."""
    return _numbered(bars, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, ["ts"])


def history_range(spark: SparkSession, end: str | None, duration: str, now: str | datetime | None = None) -> tuple[datetime, datetime]:
    """Begin (not included) and end (included) of a history request, as a vendor takes it; an end that is blank is now.

    They are found once, before a plan is made, so that they are literals in it and prune files and partitions.
    """
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    last = parse_end(F.lit(end).cast("string"), at)
    row = spark.range(1).select((last - parse_duration(F.lit(duration))).alias("first"), last.alias("last")).first()
    if row.first is None or row.last is None:
        raise ValueError(f"no history range: end {end!r}, duration {duration!r}")
    return row.first, row.last


def slice_history(bars: DataFrame, end: Column | str | None, duration: str, now: str | datetime | None = None) -> DataFrame:
    """Bars of the duration up to end, end included.

    end is a column, with a duration such as `7 DAYS`, or as vendors have it: blank, epoch seconds, ISO-8601 or yyyyMMdd
    HH:mm:ss, with a duration such as `30 D`. Over stored bars the filter reaches the scan.
    """
    if isinstance(end, Column):
        return bars.filter((F.col("ts") <= end) & (F.col("ts") > end - F.expr(f"INTERVAL {duration}")))
    first, last = history_range(bars.sparkSession, end, duration, now)
    return bars.filter((F.col("ts") > F.lit(first)) & (F.col("ts") <= F.lit(last)))


def slice_built_bars(ticks: DataFrame, end: str | None, duration: str, size: str = "1 hour", now: str | datetime | None = None) -> DataFrame:
    """slice_history() of build_bars(), which reads the ticks of those bars only."""
    first, last = history_range(ticks.sparkSession, end, duration, now)
    ts = F.col("ts")
    own = ticks.filter((ts > F.lit(first)) & (ts < F.lit(last) + F.expr(f"INTERVAL {size}")))
    return build_bars(own, size).filter((ts > F.lit(first)) & (ts <= F.lit(last)))


#: Buckets of symbols that a bar store is parted by.
SYMBOL_BUCKETS = 16


def _bucket(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def write_bar_store(bars: DataFrame, path: str, buckets: int = SYMBOL_BUCKETS, files: int | None = None) -> None:
    """Bars as Parquet, parted by symbol bucket and day, and sorted by symbol and time within files.

    A day of a bucket is dealt by symbol and time to tasks of about even size, so a hot symbol fills files of its own.
    """
    n = files or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bars.withColumns({"symbol_bucket": _bucket(F.col("symbol"), buckets), "day": F.to_date("ts")})
    rows.repartitionByRange(n, "symbol_bucket", "day", "symbol", "ts").sortWithinPartitions("symbol_bucket", "day", "symbol", "ts").write.partitionBy("symbol_bucket", "day").mode("overwrite").parquet(path)


def read_bar_store(spark: SparkSession, path: str, end: str | None, duration: str, symbols: list[str] | None = None, now: str | datetime | None = None, buckets: int = SYMBOL_BUCKETS) -> DataFrame:
    """slice_history() of a bar store, of all symbols or the given ones; only folders of their buckets and the range's days are read."""
    first, last = history_range(spark, end, duration, now)
    days_of = spark.range(1).select(F.to_date(F.lit(first)).alias("a"), F.to_date(F.lit(last)).alias("b")).first()
    rows = spark.read.parquet(path).filter(F.col("day").between(F.lit(days_of.a), F.lit(days_of.b)))
    if symbols is not None:
        own = spark.createDataFrame([(x,) for x in symbols], "symbol string").select(_bucket(F.col("symbol"), buckets).alias("b")).distinct().collect()
        rows = rows.filter(F.col("symbol_bucket").isin([r.b for r in own]) & F.col("symbol").isin(symbols))
    return rows.filter((F.col("ts") > F.lit(first)) & (F.col("ts") <= F.lit(last))).drop("symbol_bucket", "day")


def filter_session(bars: DataFrame, start: str = "09:30", end: str = "16:00", zone: str = "UTC") -> DataFrame:
    """Bars that start in regular hours, start included and end not, as local time of day."""
    day = F.date_format(F.from_utc_timestamp("ts", zone), "HH:mm")
    return bars.filter((day >= start) & (day < end))


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Vendor bars as text: prices that are missing become 0, volumes null; rows without a usable time have ts_epoch_s null."""
    price = {c: F.coalesce(clean_double(F.col(c)), F.lit(0.0)) for c in ("open", "high", "low", "close")}
    return raw.withColumns({**price, "volume": clean_double(F.col("volume")), "ts_epoch_s": parse_epoch(F.col("date"))})


def preview_bars(bars: DataFrame, n: int = 5) -> DataFrame:
    """For each symbol its number of bars and its first n."""
    ordered = W.partitionBy("symbol").orderBy("ts")
    total = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    return bars.withColumn("row_no", F.row_number().over(ordered)).filter(F.col("row_no") <= n).join(total, "symbol")
