"""Operators with state by key: status transitions with a tracking timeout, latest quotes with a time to live, and the order of bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantspark.operators.audit import TERMINAL
from quantspark.streaming.run import ROCKSDB


def _micros(c: str) -> Column:
    """Microseconds since 1970: as numbers, times do not depend on the zone of the machine that a task runs on."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def _milliseconds(micros: int) -> int:
    """Rounded up, as a timer must not end before its time."""
    return -(-micros // 1000)


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def timer(self, micros: int | None) -> None:
        """Replaces the key's timer."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if micros is not None:
            self.handle.registerTimer(_milliseconds(micros))

    def close(self) -> None:
        pass


class _Transitions(_Processor):
    """Remembers, for each order of a bucket, its last status, the time of that, and when the order runs out of time; null where it is closed or reported.

    A state call costs far more than a row, so a bucket's orders share one state and one timer.
    """

    def __init__(self, timeout_s: float | None, event_time: bool, keys: tuple[str, ...]):
        self.timeout, self.event_time, self.keys = None if timeout_s is None else int(timeout_s * 1e6), event_time, keys
        self.message = f"timeout_seconds={timeout_s}"
        self.schema = ", ".join(f"k{i} array<string>" for i in range(len(keys))) + ", status array<string>, at array<long>, due array<long>, timer long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.orders = handle.getValueState("orders", self.schema)

    def _row(self, key: tuple, i: int, at: int, status: str | None, late: bool = False) -> tuple:
        return *key, i, at, status, "oms.track" if late else None, self.message if late else None

    def _frame(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame(found, columns=[*self.keys, "id", "at", "status", "where_text", "message"])

    def _known(self) -> tuple[dict[tuple, tuple], int | None]:
        """Orders by key as (status, at, due), and the time of the bucket's timer in milliseconds."""
        found, n = self.orders.get(), len(self.keys)
        if found is None:
            return {}, None
        return dict(zip(zip(*found[:n], strict=True), zip(*found[n : n + 3], strict=True), strict=True)), found[n + 3]

    def _keep(self, known: dict[tuple, tuple], timer: int | None, fired: bool = False) -> None:
        """Writes the orders, with a timer for the first that runs out of time."""
        due = min((o[2] for o in known.values() if o[2] is not None), default=None)
        due = None if due is None else _milliseconds(due)
        if due != timer:
            if timer is not None and not fired:  # a timer that has fired goes by itself
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.orders.update((*map(list, zip(*known, strict=True)), *map(list, zip(*known.values(), strict=True)), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        orders, timer = self._known()
        events: dict[tuple, list] = {}
        for df in rows:
            texts = [[None if v != v else v for v in df[c]] for c in (*self.keys, "status")]  # a missing text may come as NaN
            for *k, status, at, i in zip(*texts, df["at"].tolist(), df["id"].tolist(), strict=True):
                events.setdefault(tuple(k), []).append((at, i, status))
        found: list[tuple] = []
        for k, own in events.items():
            known = orders.get(k)
            for at, i, status in sorted(own):
                if self.event_time and known and known[2] is not None and at > known[2]:
                    found.append(self._row(k, -1, known[2], known[0], True))
                if known is None or known[0] != status:
                    found.append(self._row(k, i, at, status))
                is_open = self.timeout is not None and (status or "").strip() not in TERMINAL
                known = status, at, at + self.timeout if is_open else None
            if known[2] is not None and not self.event_time:
                known = *known[:2], timerValues.getCurrentProcessingTimeInMs() * 1000 + self.timeout
            orders[k] = known
        self._keep(orders, timer)
        yield from self._frame(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        orders, timer = self._known()
        now = max(timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        found: list[tuple] = []
        for k, (status, at, due) in orders.items():
            if due is not None and _milliseconds(due) < now:
                orders[k] = status, at, None
                found.append(self._row(k, -1, due, status, True))
        self._keep(orders, timer, True)
        yield from self._frame(found)


#: Buckets that orders are dealt to.
BUCKETS = 1 << 13


def stream_transitions(events: DataFrame, timeout_s: float | None = None, keys: tuple[str, ...] = ("order_id",), delay: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """events(order_id, id, ts, status) -> events whose status differs from the order's last one, over all batches.

    With run_id among the keys each run starts anew. Null statuses equal each other. With timeout_s, an order that is open
    and has had no event for longer gives a row with id -1 and where_text oms.track, once until its next event.

    With delay, time is that of the events, which come at most so much out of order: the row has the time at which the
    order ran out of it, and is there as soon as an event of any order is `delay` past that. Which rows there are then does
    not depend on how the events are cut into batches. Without delay, time is that of the machine.

    Orders are remembered by buckets of their hash, since calls to the state and results cost by group: a batch writes the
    buckets that it has events for. With very many orders, more buckets keep what it writes small; a checkpoint fixes them.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    by_event = timeout_s is not None and delay is not None
    rows = events.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), *[F.col(k).cast("string").alias(k) for k in keys], _micros("ts").alias("at"), "id", "status", "ts")
    rows = rows.withWatermark("ts", delay) if by_event else rows.drop("ts")
    out = ", ".join(f"{k} string" for k in keys) + ", id long, at long, status string, where_text string, message string"
    mode = "none" if timeout_s is None else "eventTime" if by_event else "processingTime"
    made = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Transitions(timeout_s, by_event, keys), outputStructType=out, outputMode="Append", timeMode=mode)
    return made.select(*[F.col(k).cast(events.schema[k].dataType).alias(k) for k in keys], "id", F.timestamp_micros("at").alias("ts"), "status", "where_text", "message")


class _Newest(_Processor):
    """Remembers the time of the newest quote; the newest of a batch decides, so rows are folded as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "at long, seen long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.newest.get()
        best = max(rows, key=lambda r: (r.at, r.seen))
        if known is None or best.at > known[0]:
            self.newest.update((best.at, best.seen))
            yield Row(symbol=key[0], at=best.at, seen=best.seen, quote=best.quote)


#: Quotes that go on at a time.
CHUNK = 1 << 16


class _Unexpired(_Processor):
    """Remembers the time of the newest quote and when it was seen. A batch's quotes are arrays of numbers, and go on in chunks."""

    def __init__(self, ttl_s: float):
        self.ttl = int(ttl_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "at long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.newest.get()
        parts = [(df[["seen", "at", "empty"]].to_numpy("int64"), df[list(QUOTED)].to_numpy("float64")) for df in rows]
        times, prices = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.lexsort((times[:, 1], times[:, 0]))
        for start in range(0, len(order), CHUNK):
            own = order[start : start + CHUNK]
            goes = []
            for k, (seen, at) in enumerate(times[own, :2].tolist()):
                if known is None or seen - known[1] > self.ttl or at > known[0]:
                    known = at, seen
                    goes.append(k)
            own = own[goes]
            yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(own), dtype=object), "seen": times[own, 0], "at": times[own, 1], "empty": times[own, 2], **{c: prices[own, k] for k, c in enumerate(QUOTED)}})
        self.newest.update(known)
        self.timer(known[1] + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.newest.clear()
        return iter(())


QUOTED = ("bid", "ask", "last", "close")
PRICES = "struct<bid:double,ask:double,last:double,close:double>"


def stream_latest_quotes(quotes: DataFrame, ttl_s: float | None = 1.0, delay: str = "0 seconds") -> DataFrame:
    """quotes(symbol, ts, seen_at, bid, ask, last, close) -> symbol, ts, bid, ask, last, close, seen_at of newer quotes.

    Of quotes in the order in which they were seen, one goes on if it is newer than the last that went on, or if that was
    seen more than ttl_s before: then it is no longer known, and an older quote will do. seen_at is the time of events;
    quotes come at most `delay` out of its order, and a symbol's state goes once it can no longer count. What goes on does
    not depend on how quotes are cut into batches. With ttl_s None state stays for good, seen_at may be missing, and of
    each batch the newest quote goes on if it is newer than all before.
    """
    quotes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    seen = "seen_at" if "seen_at" in quotes.columns else "ts"
    at = [_micros("ts").alias("at"), _micros(seen).alias("seen")]
    if ttl_s is None:
        rows = quotes.select("symbol", *at, F.struct(*QUOTED).cast(PRICES).alias("quote"))
        made = rows.groupBy("symbol").transformWithState(statefulProcessor=_Newest(), outputStructType=f"symbol string, at long, seen long, quote {PRICES}", outputMode="Update", timeMode="none")
        return made.select("symbol", F.timestamp_micros("at").alias("ts"), "quote.*", F.timestamp_micros("seen").alias("seen_at"))
    # numbers of pandas cannot be null, so one says which prices are
    empty = sum((F.col(c).isNull().cast("int") * 2**k for k, c in enumerate(QUOTED)), F.lit(0))
    rows = quotes.select("symbol", F.col(seen).alias("seen_at"), *at, empty.cast("long").alias("empty"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in QUOTED]).withWatermark("seen_at", delay)
    out = "symbol string, seen long, at long, empty long, " + ", ".join(f"{c} double" for c in QUOTED)
    made = rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_Unexpired(ttl_s), outputStructType=out, outputMode="Append", timeMode="eventTime")
    price = lambda k, c: F.when(F.col("empty").bitwiseAND(2**k) == 0, F.coalesce(c, F.lit(float("nan")))).alias(c)
    return made.select("symbol", F.timestamp_micros("at").alias("ts"), *[price(k, c) for k, c in enumerate(QUOTED)], F.timestamp_micros("seen").alias("seen_at"))


class _Unsorted(_Processor):
    """Remembers the last time of a symbol's bars."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for i, at in sorted((r.bar_index, r.ts_epoch_s) for r in rows):
            if last is not None and at < last:
                yield Row(symbol=key[0], bar_index=i, code="not_sorted")
            last = at
        self.last.update((last,))


class _Repeated(_Processor):
    """Remembers the times of a symbol's bars within a stretch of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getValueState("times", "known array<double>, without boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known, without = (set(self.times.get()[0]), self.times.get()[1]) if self.times.exists() else (set(), False)
        for i, at in sorted(((r.bar_index, r.ts_epoch_s) for r in rows), key=lambda r: r[0]):
            if at in known or (at is None and without):
                yield Row(symbol=key[0], bar_index=i, code="duplicate_timestamp")
            if at is None:
                without = True
            else:
                known.add(at)
        self.times.update((sorted(known), without))


ORDER = "symbol string, bar_index long, code string"


def stream_order_issues(bars: DataFrame, stretch_s: float = 86400.0) -> DataFrame:
    """bars(symbol, bar_index, ts_epoch_s) in order of bar_index over all batches -> symbol, bar_index, code.

    not_sorted: the time is before the last one that was there. duplicate_timestamp: an earlier bar has the time; bars
    without a time agree, times that are not numbers do not. Times are remembered by stretches of so many seconds, many
    keys for a symbol, and what a key remembers is bounded by the times of a stretch; the last time is one number a symbol.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = bars.select("symbol", "bar_index", F.col("ts_epoch_s").cast("double").alias("ts_epoch_s"))
    run = lambda df, keys, what: df.groupBy(*keys).transformWithState(statefulProcessor=what, outputStructType=ORDER, outputMode="Append", timeMode="none")
    unsorted = run(rows.filter("ts_epoch_s is not null"), ["symbol"], _Unsorted())
    again = rows.filter("ts_epoch_s is null or not isnan(ts_epoch_s)").withColumn("stretch", F.floor(F.col("ts_epoch_s") / stretch_s))
    return unsorted.unionByName(run(again, ["symbol", "stretch"], _Repeated()))
