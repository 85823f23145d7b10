"""Joins, windows and aggregations over bars, orders, fills and audit tables."""
