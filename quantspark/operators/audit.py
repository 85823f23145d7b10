"""Status histories, reconciliation and counts over audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses after which an order does not change.
TERMINAL = ("Filled", "Cancelled", "ApiCancelled", "Inactive", "Rejected")


def is_terminal(status: Column, values: tuple[str, ...] = TERMINAL) -> Column:
    return F.coalesce(F.trim(status).isin(*values), F.lit(False))


def status_transitions(events: DataFrame, keys: tuple[str, ...] = ("order_id",)) -> DataFrame:
    """Events whose status differs from the one before, by ts and id; with run_id among the keys, each run starts anew."""
    before = F.lag(F.struct("status")).over(W.partitionBy(*keys).orderBy("ts", "id"))
    return events.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before.status").eqNullSafe(F.col("status"))).drop("_before")


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("order_id").agg(F.max_by("status", F.struct("ts", "id")).alias("status"))


def orders_current(orders: DataFrame, events: DataFrame) -> DataFrame:
    """orders with the latest status that was recorded, else the one they were placed with."""
    latest = latest_status(events).withColumnRenamed("status", "_latest")
    return orders.join(latest, "order_id", "left").withColumn("status", F.coalesce("_latest", "status")).drop("_latest")


def non_terminal_orders(orders: DataFrame) -> DataFrame:
    """Distinct ids of orders that may still change; the filter is applied before the shuffle."""
    return orders.filter(~is_terminal(F.col("status"))).select("order_id").distinct()


def audit_counts(decisions: DataFrame) -> DataFrame:
    """Decisions by run and reason, and how many were accepted."""
    return decisions.groupBy("run_id", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("accepted") == 1).alias("n_accepted"))


def status_event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("order_id").agg(F.count("*").alias("n_events"))


def orders_to_track(open_orders: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders open at the broker, and stored ones that are not terminal and not open there."""
    stored = non_terminal_orders(orders).join(open_orders.select("order_id"), "order_id", "left_anti")
    return open_orders.select("order_id", F.lit("broker").alias("origin")).unionByName(stored.withColumn("origin", F.lit("store")))


def reconcile(orders: DataFrame, open_orders: DataFrame, lookup: DataFrame) -> DataFrame:
    """Stored orders that are not terminal with the broker's status: from its open orders, else looked up, else null."""
    o, s = open_orders.select("order_id", F.col("status").alias("open_status")), lookup.select("order_id", F.col("status").alias("known_status"))
    joined = non_terminal_orders(orders).join(o, "order_id", "left").join(s, "order_id", "left")
    return joined.select("order_id", F.coalesce("open_status", "known_status").alias("status"))


def reconcile_errors(orders: DataFrame, open_orders: DataFrame, lookup: DataFrame) -> DataFrame:
    """Error rows for stored orders that the broker does not know."""
    lost = non_terminal_orders(orders).join(open_orders, "order_id", "left_anti").join(lookup, "order_id", "left_anti")
    return lost.select(F.lit("oms.reconcile").alias("where_text"), F.concat(F.lit("order_id="), "order_id").alias("message"))


def order_state(events: DataFrame, sticky_terminal: bool = True) -> DataFrame:
    """events(order_id, seq, event PLACE|MODIFY|CANCEL|FILL, quantity) -> status, quantity and filled quantity of each order.

    Sticky: the first FILL or CANCEL decides. Otherwise the last of them does, so a filled order can be cancelled and
    keeps what it filled. A MODIFY replaces the quantity of the latest request and reopens nothing.
    """
    ends = F.when(F.col("event").isin("FILL", "CANCEL"), F.struct("seq", "event"))
    end = F.min(ends) if sticky_terminal else F.max(ends)
    request = F.max(F.when(F.col("event").isin("PLACE", "MODIFY"), F.struct("seq", "quantity")))
    out = events.groupBy("order_id").agg(end.alias("end"), request.alias("request"), F.min(F.when(F.col("event") == "FILL", F.col("seq"))).alias("fill_seq"))
    status = F.when(F.col("end.event") == "FILL", "Filled").when(F.col("end.event") == "CANCEL", "Cancelled").otherwise("Submitted")
    filled = F.col("end.event") == "FILL" if sticky_terminal else F.col("fill_seq").isNotNull()
    return out.select("order_id", status.alias("status"), F.col("request.quantity").alias("quantity"), F.when(F.coalesce(filled, F.lit(False)), F.col("request.quantity")).otherwise(0.0).alias("filled"))
